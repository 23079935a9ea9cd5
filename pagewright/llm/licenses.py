"""License scans with a positional rare-token index. DataFrame functions only.

A text is reduced to the licence words in it and their positions. The index of
notices (word, notice, position) holds the highest-IDF word of each notice's key
phrase; every occurrence of it in a text proposes a place for its notice. At a
place the words of text and notice are intersected by relative position, and the
notice's key phrase must be complete, so no place that counts is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import materialize

_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLOT = 256  # numbers of words per position in a packed hit

# Phrases reported wherever they stand, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Label, key phrase, notice.
NOTICES = (
    ("apache-2.0", "apache license version 2", "licensed under the apache license version 2 0"),
    ("mit", "mit license", "released under the mit license"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "cc by nc 4", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4", "licensed under cc by sa 4 0"),
    ("bsd", "source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "isc license", "licensed under the isc license"),
)

@dataclass(frozen=True)
class LicenseParams:
    """``least``: share of a notice's IDF that must stand."""

    least: float = 0.6


def _vocabulary() -> dict[str, int]:
    words = sorted({w for p in PHRASES for w in p.split()} | {w for _, _, n in NOTICES for w in n.split()})
    return {w: i + 1 for i, w in enumerate(words)}


def _hits(text: Column) -> tuple[Column, Column]:
    """Number of words and the packed licence words ``position * _SLOT + number``, by position."""
    known = _vocabulary()
    names = F.array(*map(F.lit, known))
    lead = (F.get("words", F.lit(0)) == "").cast("int")
    trail = ((F.size("words") > 1) & (F.get("words", F.size("words") - 1) == "")).cast("int")
    pack = lambda w, i: F.when(
        F.lower(w).isin(*known) & F.translate(w, _UPPER, _LOWER).isin(*known),
        (i - lead).cast("long") * _SLOT + F.array_position(names, F.translate(w, _UPPER, _LOWER)))
    return (F.size("words") - lead - trail).cast("long"), F.array_compact(F.transform("words", pack))


def _starts(phrase: list[int]) -> Column:
    """Positions where the words stand in a row: such hits are neighbours in ``hits``."""
    def start(h: Column, i: Column) -> Column:
        here = h % _SLOT == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            here &= F.coalesce(F.get("hits", i + k) == h + (k * _SLOT + word - phrase[0]), F.lit(False))
        return F.when(here, F.floor(h / _SLOT))

    return F.array_compact(F.transform("hits", start))


def scan_licenses(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """Licence phrases and notices of every row of ``docs(doc_id, text)``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased;
    null and empty texts have none, an empty table gives no row. A place costs
    its notice's length, so long texts of many notices take linear time. Of key
    words with equal IDF the first is indexed. Returns doc_id, n_words, n_base (places of
    base phrases), first_word and last_word (their smallest and largest start,
    null without one), base_labels, labels (base ones and notices, distinct and
    sorted), score (the best notice's share, 1 for a base phrase alone) and
    ``notices`` (label, word, share). Rows that repeat an id are scanned each;
    other columns are ignored. IDF is counted over all rows.
    """
    known = _vocabulary()
    words = docs.select("doc_id", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _SEPARATOR).alias("words"))
    n_words, hits = _hits(F.col("words"))
    found = materialize(words.select("doc_id", n_words.alias("n_words"), hits.alias("hits")), "licence-words")
    # One row per licence word.
    seen = found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h % _SLOT))).alias("word")).groupBy("word").count()
    total = found.count()
    frequency = {r["word"]: r["count"] for r in seen.collect()}
    idf = {i: float(f"{_idf(total, frequency.get(i, 0)):.9f}") for i in known.values()}
    postings: dict[int, list[tuple[int, int]]] = {}
    for n, (_, key, notice) in enumerate(NOTICES):
        start = _start(notice.split(), key.split())
        k, word = max(enumerate(key.split()), key=lambda w: (idf[known[w[1]]], -w[0]))
        postings.setdefault(known[word], []).append((n, start + k))
    place = "array<struct<notice:int,at:bigint>>"
    index = F.array(*(F.array(*(F.struct(F.lit(n).alias("notice"), F.lit(at).cast("long").alias("at")) for n, at in postings.get(i, []))).cast(place)
                      for i in range(len(known) + 1)))
    anchors = F.array_compact(F.transform("hits", lambda h, i: F.when((h % _SLOT).isin(*postings), F.struct(h.alias("hit"), i.alias("i")))))
    # A notice has one posting, so no place is proposed twice.
    proposed = F.flatten(F.transform(anchors, lambda a: F.transform(
        F.get(index, (a["hit"] % _SLOT).cast("int")),
        lambda p: F.struct(p["notice"].alias("notice"), (F.floor(a["hit"] / _SLOT) - p["at"]).alias("at"), a["i"].alias("i")))))

    def shares(p: Column) -> Column:
        out = F.lit(None).cast("double")
        for n, (_, key, notice) in enumerate(NOTICES):
            terms = notice.split()
            codes = [at * _SLOT + known[w] for at, w in enumerate(terms)]
            weights = [idf[known[w]] for w in terms]
            start = _start(terms, key.split())
            must = F.array(*(F.lit(c).cast("long") for c in codes[start:start + len(key.split())]))
            # Hits of the place are at most the notice's length away from the anchor.
            near = F.slice("hits", F.greatest(p["i"] - (len(terms) - 1), F.lit(0)) + 1, F.lit(2 * len(terms) - 1))
            here = F.transform(
                F.filter(near, lambda h: (h >= p["at"] * _SLOT) & (h < (p["at"] + len(terms)) * _SLOT)),
                lambda h: h - p["at"] * _SLOT)
            weight = F.array(*map(F.lit, weights))
            both = F.array_intersect(here, F.array(*(F.lit(c).cast("long") for c in codes)))
            got = F.aggregate(both, F.lit(0.0), lambda s, c: s + F.get(weight, F.floor(c / _SLOT).cast("int")))
            complete = F.size(F.array_intersect(both, must)) == len(set(codes[start:start + len(key.split())]))
            out = F.when((p["notice"] == n) & complete, F.least(got / sum(weights), F.lit(1.0))).otherwise(out)
        return out

    labels = F.array(*(F.lit(name) for name, _, _ in NOTICES))
    notices = F.filter(
        F.transform("proposed", lambda p: F.struct(F.get(labels, p["notice"]).alias("label"), p["at"].alias("word"), shares(p).alias("share"))),
        lambda p: p["share"] >= params.least)
    base = {label: _starts([known[w] for w in phrase.split()]) for phrase, label in PHRASES.items()}
    every = F.concat(*(F.col(f"_{k}") for k in range(len(base))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"_{k}") > 0, F.lit(label)) for k, label in enumerate(base))))
    scanned = (
        found.withColumn("proposed", proposed)
        .withColumn("notices", F.coalesce(notices, F.array().cast("array<struct<label:string,word:bigint,share:double>>")))
        .withColumns({f"_{k}": starts for k, starts in enumerate(base.values())})
        .withColumn("places", every).withColumn("base", base_labels)
    )
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.array_max(F.transform("notices", lambda p: p["share"]))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.transform("notices", lambda p: p["label"]))).alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
        "notices")


def _start(terms: list[str], key: list[str]) -> int:
    return next(i for i in range(len(terms)) if terms[i:i + len(key)] == key)


def _idf(total: int, frequency: int) -> float:
    from math import log

    return log((total + 1) / (frequency + 1)) + 1
