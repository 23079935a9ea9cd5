"""HTML extraction with built-in expressions.

Two passes of one alternation each take out what carries no text: comments and
raw-text elements first, in document order, so that a comment holding
``<script>`` or a script holding ``</nav>`` is read as a parser reads it; then
the boilerplate elements. ``is_plain_html`` says for which pages this is exact;
``functions.html_strict`` parses the others.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import join_lines, strip

# Elements whose whole content is dropped, and elements whose
# text does not count as page text.
BOILERPLATE_TAGS = ("nav", "header", "footer", "aside")
RAW_TAGS = ("script", "style")
HIDDEN_TAGS = ("template", "rt", "rp")
# Elements that never have content.
VOID_TAGS = tuple(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)

# Character references decoded natively, ``&amp;`` last.
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)


def _element(tag: str) -> str:
    return rf"<{tag}(?:[\s/][^>]*)?>.*?</{tag}\s*>"


_RAW = "(?is)<!--.*?-->|" + "|".join(_element(t) for t in RAW_TAGS)
_BOILERPLATE = "(?is)" + "|".join(_element(t) for t in BOILERPLATE_TAGS + HIDDEN_TAGS)
_TITLE = r"(?is)<title(?:[\s/][^>]*)?>(.*?)</title\s*>"
_TITLE_TAG = r"(?i)<title(?:[\s/][^>]*)?>"
_TAG = r"<[A-Za-z/!?][^>]*>"
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_raw(html: Column | str) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(_col(html), _RAW, "")


def strip_boilerplate(markup: Column | str) -> Column:
    """``strip_raw`` output without navigation, headers, footers, asides."""
    return F.regexp_replace(_col(markup), _BOILERPLATE, "")


def page_title(markup: Column | str) -> Column:
    """Text of the first title; ``No Title`` when the page has none."""
    markup = _col(markup)
    title = strip(decode_entities(F.regexp_extract(markup, _TITLE, 1)))
    return F.when(markup.rlike(_TITLE_TAG), title).otherwise(F.lit("No Title"))


def page_text(body: Column | str) -> Column:
    """Text nodes of ``strip_boilerplate`` output, joined with no separator."""
    return decode_entities(F.regexp_replace(_col(body), _TAG, ""))


def page_content(body: Column | str) -> Column:
    """Page text with its lines stripped and joined by one space."""
    return join_lines(page_text(body))


def anchor_hrefs(markup: Column | str) -> Column:
    """``href`` values of all anchors of ``strip_raw`` output, in order."""
    found = F.regexp_extract_all(_col(markup), F.lit(_HREF), F.lit(1))
    return F.transform(
        found, lambda v: decode_entities(F.regexp_replace(v, r"""^["']|["']$""", ""))
    )


def _closed(text: Column, starts: tuple[tuple[str, str], ...]) -> Column:
    """True where no last start stands after the last end of its kind.

    Then every lazy search for an end finds one, so the searches take linear time.
    """
    unclosed = [text.rlike(rf"(?is)\A(?>.*{start})(?!.*{end})") for start, end in starts]
    return ~reduce(or_, unclosed)


def raw_is_closed(html: Column | str) -> Column:
    """True where ``strip_raw`` takes linear time: no comment, script or style is left open."""
    tags = tuple((rf"<{t}(?=[\s/>])", rf"</{t}\s*>") for t in RAW_TAGS)
    return _closed(_col(html), (("<!--", "-->"), *tags))


def boilerplate_is_closed(markup: Column | str) -> Column:
    """The same for ``strip_boilerplate`` and ``page_title``."""
    return _closed(_col(markup), tuple((rf"<{t}(?=[\s/>])", rf"</{t}\s*>") for t in BOILERPLATE_TAGS + HIDDEN_TAGS + ("title",)))


def _ends_inside(span: Column) -> Column:
    """True where every end tag inside a removed element closes a start tag inside it.

    Another end tag may close the removed element itself, and the last one must
    not belong to an element of that name inside it. Elements with very many
    tags count as not so; the parser reads their pages.
    """
    tags = F.regexp_extract_all(F.lower(span), F.lit(r"<(/?[a-z][^\s/>]*)(?:[^>]*[^/>])?>"), F.lit(1))
    inner = F.slice(tags, 2, F.greatest(F.size(tags) - 2, F.lit(0)))

    def step(open_: Column, tag: Column) -> Column:
        at = F.array_position(open_, F.substring(tag, 2, 100))
        ended = F.when(at > 0, F.slice(open_, at.cast("int") + 1, F.size(open_)))
        started = F.when(tag.isin(*VOID_TAGS), open_).otherwise(F.concat(F.array(tag), open_))
        return F.when(F.startswith(tag, F.lit("/")), ended).otherwise(started)

    left = F.aggregate(inner, F.array().cast("array<string>"), step)
    return F.when(F.size(tags) <= 2000, F.coalesce(~F.array_contains(left, F.get(tags, F.lit(0))), F.lit(False))).otherwise(False)


def is_plain_html(markup: Column, body: Column) -> Column:
    """True where the expressions above give what a parser gives.

    Takes the outputs of ``strip_raw`` and ``strip_boilerplate``; false where one
    is null. False for unclosed, crossed, nested or self-closing elements of the
    dropped kinds, for quoted attribute values with angle brackets, for markup in
    titles, stray ``<``, unusual character references, attributes without a
    space before them and ``href`` without a value.
    """
    dropped = "|".join(RAW_TAGS + BOILERPLATE_TAGS + HIDDEN_TAGS)
    spans = F.when(body.isNotNull(), F.regexp_extract_all(markup, F.lit(_BOILERPLATE), F.lit(0)))
    known = "|".join(name[1:-1] for name, _ in ENTITIES)
    odd = [
        body.rlike(rf"(?i)</?(?:{dropped})[\s/>]"),
        markup.rlike(r"""=\s*(?:"[^"<>]*[<>]|'[^'<>]*[<>])"""),
        markup.rlike(r"<!(?!(?i:doctype)\b)|<\?|<(?![A-Za-z/!?])|<[^>]*(?:<|$)"),
        markup.rlike(rf"&(?!(?:{known});)"),
        markup.rlike(r"(?i)<a\s(?:[^>]*\s)?href(?!\s*=)|href\s*=[^>]*\shref\s*="),
        markup.rlike(r"(?is)<title[^>]*>[^<]*<(?!/title)|<title\s*/>|<(?:textarea|plaintext|xmp|svg|math)\b"),
        markup.rlike(rf"(?i)<(?:{dropped})(?:[\s/][^>]*)?/>"),
        markup.rlike(r"""(?i)<a/|[/"']href\s*=|href\s*=\s*(?:=|>|[^\s"'>]+["'])|=\s*(?:"[^"<>]*"|'[^'<>]*')[^\s/>]"""),
        ~F.forall(spans, _ends_inside),
    ]
    return ~F.coalesce(reduce(or_, odd), F.lit(True))

