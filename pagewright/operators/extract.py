"""Raw page tables to page records and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions.html_strict import join_urls, read_pages
from pagewright.functions.text import computed
from pagewright.functions.urls import (
    base_parts,
    canonical_url,
    extract_domain,
    is_web_url,
    resolve_all,
)

PARSERS = ("auto", "native", "strict")


def with_markup(pages: DataFrame) -> DataFrame:
    """Adds ``markup`` (no comments, scripts, styles) and ``body`` (also no
    boilerplate), the two inputs of every HTML function."""
    markup = pages.withColumn("markup", H.strip_raw(F.coalesce("html", F.lit(""))))
    return markup.withColumn("body", H.strip_boilerplate("markup"))


def extract_text(pages: DataFrame, parser: str = "auto", links: bool = True) -> DataFrame:
    """Replace ``html`` by title, content and (optionally) hrefs.

    ``native`` uses expressions only. ``strict`` parses every page. ``auto``
    uses expressions and parses the pages for which they are not exact.
    """
    if parser not in PARSERS:
        raise ValueError(f"parser must be one of {', '.join(PARSERS)}")
    keep = [c for c in pages.columns if c != "html"]
    if parser == "strict":
        parsed = pages.withColumn("_p", read_pages("html"))
        columns = ["_p.title", "_p.content", *(["_p.hrefs"] if links else [])]
        return parsed.select(*keep, *columns)
    native = {
        "title": H.page_title("markup"),
        "content": H.page_content("body"),
    }
    if links:
        native["hrefs"] = H.anchor_hrefs("markup")
    if parser == "native":
        return with_markup(pages).select(*keep, *[c.alias(n) for n, c in native.items()])
    marked = (
        pages.withColumn("markup", F.when(H.raw_is_closed(F.coalesce("html", F.lit(""))), H.strip_raw(F.coalesce("html", F.lit("")))))
        .withColumn("body", F.when(H.boilerplate_is_closed("markup"), H.strip_boilerplate("markup")))
    )
    plain = H.is_plain_html(F.col("markup"), F.col("body"))
    columns = {n: F.when(F.col("_plain"), c) for n, c in native.items()}
    ready = marked.withColumn("_plain", plain).select(
        *keep, "_plain", F.when(~F.col("_plain"), F.col("html")).alias("_odd"),
        *[c.alias(n) for n, c in columns.items()],
    )
    parsed = ready.withColumn("_p", read_pages("_odd"))
    merged = [F.coalesce(F.col(n), F.col(f"_p.{n}")).alias(n) for n in native]
    return parsed.select(*keep, *merged)


def _with_links(extracted: DataFrame, name: str) -> DataFrame:
    """Adds the resolved ``hrefs``, null or not a web URL where there is none.

    The parts of the base are columns of their own, so a page works them out
    once and not once per link.
    """
    parts = base_parts("url")
    based = extracted.select("*", *[c.alias(f"_base_{n}") for n, c in parts.items()])
    base = {n: F.col(f"_base_{n}") for n in parts}
    linked = based.withColumn(name, resolve_all(base, "hrefs"))
    return linked.select(*extracted.columns, name)


def anchors(extracted: DataFrame) -> DataFrame:
    """One row per anchor with an ``href``: page_id, url, pos, href."""
    return extracted.select("page_id", "url", F.posexplode(computed("hrefs")).alias("pos", "href"))


def resolved_links(extracted: DataFrame, parser: str = "native") -> DataFrame:
    """One row per anchor with a web target: page_id, url, pos, href, link.

    Narrow: every link comes out of its own page's row. ``strict`` resolves
    with the standard library instead of expressions.
    """
    if parser == "strict":
        linked = anchors(extracted).withColumn("link", canonical_url(join_urls("url", "href")))
    else:
        pairs = F.arrays_zip("hrefs", "_links")
        rows = _with_links(extracted, "_links").select(
            "page_id", "url", F.posexplode(pairs).alias("pos", "_l")
        )
        linked = rows.select("page_id", "url", "pos", F.col("_l.hrefs").alias("href"), F.col("_l._links").alias("link"))
    return linked.where(is_web_url("link"))


def _web_links() -> Column:
    return F.array_distinct(F.filter("_links", lambda link: is_web_url(link)))


def page_outlinks(extracted: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Distinct links of each page in document order: page_id, url, pos, link.

    The links of one page are one array, so duplicates go inside the row and
    nothing is shuffled. ``allowed`` filters a column named ``link``.
    """
    rows = _with_links(extracted, "_links").select(
        "page_id", "url", F.posexplode(_web_links()).alias("pos", "link")
    )
    return rows if allowed is None else rows.where(allowed)


def page_records(pages: DataFrame, parser: str = "auto", links: bool = True) -> DataFrame:
    """Raw pages to full page records, with ``links``: the distinct web links in document order.

    Only pages fetched with status 200 become records; a table without a
    ``status_code`` column holds successful fetches only.
    """
    if "status_code" in pages.columns:
        fetched = pages.where(F.col("status_code") == 200)
    else:
        fetched = pages.withColumn("status_code", F.lit(200))
    records = extract_text(fetched, parser, links).withColumn("domain", extract_domain("url"))
    return _with_links(records, "_links").withColumn("links", _web_links()).drop("_links") if links else records
