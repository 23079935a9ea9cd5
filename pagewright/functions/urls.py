"""URL functions: domains, validity, resolution against a base, clean-up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"
_PARTS = rf"^(?:({_SCHEME}):)?(?:(//)([^/?#]*))?([^?#]*)(\?[^#]*)?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tidy(url: Column) -> Column:
    """URL parsers ignore control characters in front, and tabs and line ends."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def _balanced(netloc: Column) -> Column:
    """A bracket without its partner makes a host unparsable."""
    return F.contains(netloc, F.lit("[")) == F.contains(netloc, F.lit("]"))


def netloc(url: Column | str) -> Column:
    return F.regexp_extract(_tidy(_col(url)), rf"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def _fold_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def extract_domain(url: Column | str) -> Column:
    """Lower-case host (with port and user info) without one leading ``www.``."""
    host = netloc(url)
    return F.when(_balanced(host), _fold_domain(host)).otherwise(F.lit("unknown"))


def fill_domain(domain: Column | str, url: Column | str) -> Column:
    """The stored domain, or the one in the URL where none is stored."""
    return F.coalesce(F.nullif(_col(domain), F.lit("")), extract_domain(url))


def display_domain(url: Column | str) -> Column:
    """Host name without port or user info and without the first ``www.``."""
    host = F.regexp_extract(
        _tidy(_col(url)), rf"^{_SCHEME}://(?:[^/?#@]*@)?([^/?#:@]+)", 1
    )
    # A replacement that captures both sides touches the first match only.
    shown = F.regexp_replace(F.lower(host), r"^(.*?)www\.(.*)$", "$1$2")
    return F.when(host == "", F.lit("unknown")).otherwise(shown)


def is_web_url(url: Column | str) -> Column:
    """http or https with a host."""
    tidy = _tidy(_col(url))
    return F.coalesce(
        tidy.rlike(r"^(?i:https?)://[^/?#]") & _balanced(netloc(url)), F.lit(False)
    )


def in_allowed_domains(url: Column | str, allowed: Sequence[str]) -> Column:
    """Host equals an allowed domain or lies below it; no list allows all.

    For the short list a job carries as a parameter. For a table of allowed
    domains use ``operators.links.filter_allowed``.
    """
    names = [fold_allowed(a) for a in allowed]
    if not names:
        return F.lit(True)
    domain = _fold_domain(netloc(url))
    below = [F.endswith(domain, F.lit("." + n)) for n in names]
    keep = domain.isin(names)
    for b in below:
        keep = keep | b
    return keep


def fold_allowed(name: str) -> str:
    return name.lower().removeprefix("www.")


def host_suffixes(domain: Column | str) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``."""
    labels = F.split(_col(domain), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def canonical_url(url: Column | str) -> Column:
    """Drop the fragment and the ``;params`` of the last path segment."""
    no_fragment = F.regexp_replace(_tidy(_col(url)), r"#.*$", "")
    no_params = F.regexp_replace(no_fragment, r"^([^?]*/[^/?;]*);[^/?]*", "$1")
    bare_query = F.regexp_replace(no_params, r"\?$", "")
    return _let(bare_query, lambda u: F.concat(
        F.lower(F.regexp_extract(u, rf"^({_SCHEME}):", 1)),
        F.regexp_replace(u, rf"^{_SCHEME}:", ":"),
    ))


def _remove_dots(path: Column) -> Column:
    """Work off ``.`` and ``..`` segments of an absolute path."""
    def kept(segments: Column) -> Column:
        return F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
            )
            .when(s == ".", acc)
            .otherwise(F.array_append(acc, s)),
        )

    # A path that ends in a dot segment names a folder.
    as_folder = F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/")
    joined = F.array_join(kept(F.split(as_folder, "/")), "/")
    rooted = F.regexp_replace(joined, r"^(?!/)", "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), rooted).otherwise(path)


def base_parts(base: Column | str) -> dict[str, Column]:
    """What resolving references against ``base`` needs to know of it."""
    base = _tidy(_col(base))
    scheme = F.lower(F.regexp_extract(base, _PARTS, 1))
    path = F.regexp_replace(F.regexp_extract(base, _PARTS, 4), r"(^|/)([^/;]*);[^/]*$", "$1$2")
    host = F.regexp_extract(base, _PARTS, 3)
    return {
        "scheme": scheme,
        "root": F.when(host != "", F.concat(scheme, F.lit("://"), host)).otherwise(F.lit("")),
        "path": path,
        "folder": F.concat(F.lit("/"), F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)),
        "query": F.regexp_extract(base, _PARTS, 5),
    }


def resolve_against(base: dict[str, Column], href: Column) -> Column:
    """Absolute, cleaned-up form of a reference, given the parts of its base.

    Covers absolute, scheme-relative, root-relative, relative with dot
    segments, query-only, fragment-only and empty references. Null when the
    reference has a scheme but no host.
    """
    names = {"scheme": 1, "host": 3, "path": 4, "query": 5}
    parts = F.struct(*[F.regexp_extract(href, _PARTS, g).alias(n) for n, g in names.items()])

    def absolute(p: Column) -> Column:
        scheme = F.lower(p["scheme"])
        merged = F.regexp_replace(F.concat(base["folder"], p["path"]), r"/{2,}", "/")
        rooted = F.when(F.startswith(p["path"], F.lit("/")), p["path"]).otherwise(merged)
        own_query = F.when(p["query"].isin("", "?"), base["query"]).otherwise(p["query"])
        return (
            F.when((scheme != "") & (scheme != base["scheme"]), F.when(p["host"] != "", href))
            .when(p["host"] != "", F.concat(
                base["scheme"], F.lit(":"), F.regexp_replace(href, rf"^{_SCHEME}:", "")
            ))
            .when(p["path"] == "", F.concat(base["root"], base["path"], own_query))
            .otherwise(F.concat(base["root"], _let(rooted, _remove_dots), p["query"]))
        )

    # The common case on real pages needs none of the parsing above.
    plain_root = href.rlike(r"^/(?:[^/?#;][^?#;]*)?$")
    no_dot_segment = ~F.contains(href, F.lit("/."))
    return F.when(plain_root & no_dot_segment, F.concat(base["root"], href)).otherwise(
        canonical_url(_let(parts, absolute))
    )


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute, cleaned-up form of ``href`` found on the page ``base``."""
    return resolve_against(base_parts(base), _tidy(_col(href)))


def resolve_all(base: dict[str, Column], hrefs: Column | str) -> Column:
    """``resolve_against`` for an array of references."""
    tidy = F.transform(_col(hrefs), _tidy)
    return F.transform(tidy, lambda h: resolve_against(base, h))
