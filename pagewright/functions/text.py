"""Text functions: cleaning, tokens, word pairs, snippets, cache keys.

Character classes are spelled out because the default ``\\s`` and ``\\w`` of the
JVM cover ASCII only, while the rules here are Unicode rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.counts import term_rows

# The characters that count as white space, the line ends among
# them, and what a word is made of.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = r"[\x{0a}-\x{0d}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
WORD_CHARS = r"\p{L}\p{N}_"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed(array: Column | str) -> Column:
    """An array to explode that is worked out rather than read.

    Exploding a bare column makes Spark filter on the column's size first, and
    so work the array out again for the filter. An expression does not.
    """
    return F.transform(_col(array), lambda x: x)


def strip(text: Column | str) -> Column:
    """Remove white space at both ends."""
    return F.btrim(_col(text), F.lit(SPACES))


def clean_text(text: Column | str) -> Column:
    """Collapse white space, strip, blank out punctuation, lower-case."""
    collapsed = F.trim(F.regexp_replace(_col(text), f"[{SPACES}]+", " "))
    return F.lower(F.regexp_replace(collapsed, f"[^{WORD_CHARS} ]", " "))


def join_lines(text: Column | str) -> Column:
    """Strip each line, drop blank lines, join the rest with one space."""
    lines = F.transform(F.split(_col(text), LINE_ENDS), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def weighted_text(title: Column | str, content: Column | str) -> Column:
    """Title twice, then content: the text the index sees."""
    return F.concat_ws(" ", _col(title), _col(title), _col(content))


def tokens(text: Column | str) -> Column:
    """Lower-cased words of two or more word characters, in order.

    Equal to tokenising ``clean_text(text)``: cleaning only changes characters
    that separate words, so it needs no pass of its own.
    """
    return F.filter(_pieces(text), lambda w: F.length(w) > 1)


def _pieces(text: Column | str) -> Column:
    return F.split(F.lower(_col(text)), f"[^{WORD_CHARS}]+")


def with_words(df: DataFrame, text: Column, stop_words: Sequence[str], *keep: str) -> DataFrame:
    """``keep`` and ``words``: the tokens of ``text`` without stop words.

    The list goes to Spark as one SQL expression, which is parsed far quicker
    than one literal per word is built.
    """
    quoted = ["'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in stop_words]
    kept = f" AND w NOT IN ({', '.join(quoted)})" if quoted else ""
    words = F.expr(f"filter(_pieces, w -> length(w) > 1{kept})")
    return df.select(*keep, _pieces(text).alias("_pieces")).select(*keep, words.alias("words"))


def bigrams(words: Column | str) -> Column:
    """Neighbouring pairs of an array of words; null where a word is null."""
    words = _col(words)
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, F.lit(1), n),
        F.slice(words, F.lit(2), n),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def words_and_pairs(words: Column | str) -> Column:
    return F.concat(_col(words), bigrams(words))


def with_counts(df: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """One row per distinct term of each row's array: ``keep``, term, tf."""
    return term_rows(df.select(*keep, terms.alias("words")), *keep, pairs=False)


def snippet(content: Column | str, chars: int = 200) -> Column:
    """The first ``chars`` characters, with ``...`` when there is more."""
    content = _col(content)
    cut = F.concat(F.substring(content, 1, chars), F.lit("..."))
    return F.when(F.length(content) > chars, cut).otherwise(content)


def domain_or_all(domain: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(domain), F.lit("")), F.lit("all"))


def cache_key(query: Column | str, domain: Column | str) -> Column:
    """md5 of the stripped lower-case query and the domain filter."""
    return F.md5(F.concat(strip(F.lower(_col(query))), F.lit("|"), domain_or_all(domain)))
