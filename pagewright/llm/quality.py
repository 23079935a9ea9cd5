"""Quality rules with distribution divergence.

A document's histograms of character classes and of common words are compared
with those of every language by the Jensen-Shannon distance; the closest
language counts. The references are sums over all documents that pass the base
rules. Texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pagewright.llm.common import raw_text, to_batch
from pagewright.session import materialize

_SYMBOLS = b"#*$%&|<>"
# Lower case, upper case, digits, white space, sentence punctuation, symbols, other ASCII, further characters.
_CLASSES = 8
_CLASS_OF = np.full(256, 6, np.uint8)
_CLASS_OF[97:123], _CLASS_OF[65:91], _CLASS_OF[48:58], _CLASS_OF[[32, 9, 10, 11, 12, 13]] = 0, 1, 2, 3
_CLASS_OF[list(b".,;:!?'\"()-")], _CLASS_OF[list(_SYMBOLS)], _CLASS_OF[192:] = 4, 5, 7


@dataclass(frozen=True)
class QualityParams:
    """``share``: a common word makes up at least this share of a language's words.
    ``farthest_*``: largest distances of a kept document; ``fewest_*``: characters and words
    from which on they are asked for."""

    window: int = 8
    fewest: int = 20
    repeat_percent: int = 30
    share: float = 0.004
    fewest_chars: int = 200
    fewest_words: int = 80
    farthest_chars: float = 0.25
    farthest_words: float = 0.45


def base_counts(text: bytes, window: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = len(text.decode(errors="replace")) - (len(text) - sum(map(len, words)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if n > window:
        each = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
        mixed = np.zeros(n - window + 1, np.uint64)
        for i in range(window):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i:n - window + 1 + i]
        order = np.argsort(mixed, kind="stable")
        same = mixed[order][1:] == mixed[order][:-1]
        if same.any():
            twice = np.zeros(len(mixed), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + window, -1)
            repeated = int((np.cumsum(covered)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _candidates(share: float):
    """Words with a share of a batch's words of a language, and all its words under a null."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(text.lower().split())
            totals = {lang: c.total() for lang, c in counts.items()}
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if n >= share * totals[lang]]
            rows += [(lang, None, n) for lang, n in totals.items()]
            yield to_batch(dict(zip(schema.names, zip(*rows))) if rows else dict.fromkeys(schema.names, ()), schema)

    return run


def _exact(candidates: set[bytes]):
    """Counts of the candidates per language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts.update((lang, w) for w in text.lower().split() if w in candidates)
        yield to_batch({"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}, schema)

    return run


def _histograms(params: QualityParams, common: list[bytes]):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((f, pa.int64()) for f in fields),
                        ("chars", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))])
    place = {w: i for i, w in enumerate(common)}
    other = len(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars, words = [], [], []
            for text in batch.column("text").to_pylist():
                rows.append(base_counts(text, params.window))
                flat = np.frombuffer(text, np.uint8)
                leading = flat[(flat < 128) | (flat >= 192)]
                chars.append(np.bincount(_CLASS_OF[leading], minlength=_CLASSES))
                found = text.lower().split()
                words.append(np.bincount(np.fromiter((place.get(w, other) for w in found), np.int64, len(found)), minlength=other + 1).astype(np.int32))
            out = dict(zip(fields, zip(*rows))) if rows else dict.fromkeys(fields, ())
            yield to_batch(out | {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "chars": chars, "words": words}, schema)

    return run


def divergence(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root, base 2) of each row of ``counts`` to ``reference``; 0 for empty rows."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    q = (reference / max(reference.sum(), 1))[None, :]
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return np.where(counts.sum(axis=1) > 0, np.sqrt(np.maximum(parts.sum(axis=1) / 2, 0)), 0)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the histograms per language."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("place", pa.int32()), ("n", pa.int64())])
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for kind in ("chars", "words") if batch.num_rows else ():
            table = _matrix(batch, kind)
            for lang in set(langs):
                total = table[langs == lang].sum(axis=0)
                yield to_batch({"lang": [lang] * len(total), "kind": [kind] * len(total), "place": range(len(total)), "n": total.astype(np.int64)}, schema)


def _distances(params: QualityParams, references: list[tuple[str, np.ndarray, np.ndarray]]):
    new = pa.schema([("reference", pa.string()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [c for c in batch.schema.names if c not in ("chars", "words")]
            n = batch.num_rows
            if not n:
                continue
            chars, words = _matrix(batch, "chars"), _matrix(batch, "words")
            by_char = np.zeros((n, max(len(references), 1)))
            by_word = np.zeros_like(by_char)
            for k, (_, c, w) in enumerate(references):
                by_char[:, k] = divergence(chars, c)
                by_word[:, k] = divergence(words, w)
            best = (by_char + by_word).argmin(axis=1)
            names = [references[k][0] if references else None for k in best]
            at = np.arange(n)
            columns = [batch.column(c) for c in keep] + [pa.array(names, pa.string()), pa.array(by_char[at, best]), pa.array(by_word[at, best])]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(c) for c in keep] + list(new)))

    return run


def judge(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Counts, distances and verdict for every row of ``docs(doc_id, text, lang)``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, reference (the closest language, null if there is none),
    char_distance, word_distance and kept. Null and empty texts have no words
    and fail the base rules. Documents without a language are judged like the
    others but are part of no reference. Rows that repeat an id are judged each.
    """
    base = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), raw_text(F.col("text")).alias("text"))
    known = source.where("lang is not null")
    found = materialize(
        known.select("lang", "text").mapInArrow(_candidates(params.share), "lang string, word binary, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "common-words")
    totals = found.where("word is null").select("lang", F.col("n").alias("total"))
    # A word with the share of all words has it in some batch; these words are counted in all documents.
    candidates = {bytes(r["word"]) for r in found.where("word is not null").select("word").distinct().collect()}
    exact = known.select("lang", "text").mapInArrow(_exact(candidates), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    common = sorted({bytes(r["word"]) for r in exact.join(totals, "lang")
                     .where(F.col("n") >= F.col("total") * params.share).select("word").distinct().collect()})
    counted = materialize(source.mapInArrow(_histograms(params, common), base + ", chars array<long>, words array<int>"), "histograms")
    failed = (F.col("n_words") < params.fewest) | (F.col("n_repeat_words") * 100 > F.col("n_words") * params.repeat_percent)
    counted = counted.withColumn("base_failed", failed)
    passed = counted.where("lang is not null and not base_failed")
    sums = passed.select("lang", "chars", "words").mapInArrow(_sums, "lang string, kind string, place int, n long")
    histograms: dict[str, dict[str, np.ndarray]] = {}
    for r in sums.groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")).collect():  # a few hundred rows per language
        sizes = {"chars": _CLASSES, "words": len(common) + 1}
        histograms.setdefault(r["lang"], {k: np.zeros(size) for k, size in sizes.items()})[r["kind"]][r["place"]] = r["n"]
    references = [(lang, h["chars"], h["words"]) for lang, h in sorted(histograms.items())]
    judged = counted.mapInArrow(_distances(params, references), base + ", base_failed boolean, reference string, char_distance double, word_distance double")
    near = ((F.col("word_chars") < params.fewest_chars) | (F.col("char_distance") <= params.farthest_chars)) & (
        (F.col("n_words") < params.fewest_words) | (F.col("word_distance") <= params.farthest_words))
    return judged.drop("lang").withColumn("kept", ~F.col("base_failed") & near)
