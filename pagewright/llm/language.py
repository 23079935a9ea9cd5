"""Language identification by prediction by partial matching.

One context tree of bytes per language, order 3, with the escape estimate
(different bytes seen) / (bytes seen + different bytes seen) and exclusion. The
statistics are frozen after training, so the code length of a byte depends on
the three bytes before it alone and is looked up. The language with the
shortest code for the whole text is predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import raw_text, to_batch
from pagewright.session import materialize

_SIZE = 128  # byte codes; 0 stands for bytes that training never saw
_SCALE = 256.0  # code lengths are kept in 1/256 bit
_LETTER = re.compile(rb"[A-Za-z]")
_PAD = b"\n\n\n"
_SLICES = 64


@dataclass(frozen=True)
class LanguageParams:
    """``documents``: most training documents per language, picked by a hash of their id."""

    documents: int = 1500


@dataclass(frozen=True)
class LanguageModel:
    """``code``: byte to code. ``third``: number of a known context of three bytes, or -1.
    ``short`` and ``long``: code lengths after two and after three bytes, a column per language."""

    languages: tuple[str, ...]
    code: np.ndarray
    third: np.ndarray
    short: np.ndarray
    long: np.ndarray


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of four-byte windows per language."""
    schema = pa.schema([("lang", pa.string()), ("window", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        groups: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            groups.setdefault(lang, []).append(text)
        for lang, texts in groups.items():
            for start in range(0, len(texts), 200):
                flat = np.frombuffer(_PAD + _PAD.join(texts[start:start + 200]), np.uint8).astype(np.int64)
                if len(flat) > 3:
                    found, n = np.unique(flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:], return_counts=True)
                    yield to_batch({"lang": [lang] * len(found), "window": found, "n": n}, schema)


def _step(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of each context's row of ``counts``, escaping to those of the shorter context."""
    n, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    seen = counts > 0
    rest = np.where(seen, 0, lower)
    left = np.maximum(rest.sum(axis=1, keepdims=True), 1e-30)
    return np.where(n > 0, np.where(seen, counts, kinds * rest / left) / np.maximum(n + kinds, 1), lower)


def build(rows: list[tuple[str, int, int]]) -> LanguageModel:
    """The model of ``(language, window, count)`` rows."""
    languages = tuple(sorted({r[0] for r in rows}))
    number = {name: i for i, name in enumerate(languages)}
    which = np.array([number[r[0]] for r in rows], np.int64)
    window = np.array([r[1] for r in rows], np.int64)
    n = np.array([r[2] for r in rows], np.float64)
    bytes_of = [window >> s & 255 for s in (24, 16, 8, 0)]
    often = np.bincount(bytes_of[3], n, 256)
    code = np.zeros(256, np.int32)
    ranked = np.argsort(-often, kind="stable")[:_SIZE - 1]
    code[ranked[often[ranked] > 0]] = np.arange(1, (often[ranked] > 0).sum() + 1)
    a, b, c, d = (code[x].astype(np.int64) for x in bytes_of)
    triple = (a << 14) | (b << 7) | c
    known = np.unique(triple)
    third = np.full(_SIZE ** 3, -1, np.int32)
    third[known] = np.arange(len(known))
    short = np.zeros((_SIZE ** 3, len(languages)), np.uint16)
    long = np.zeros((len(known) * _SIZE, len(languages)), np.uint16)
    for k in range(len(languages)):
        mine = which == k

        def table(context: np.ndarray, size: int) -> np.ndarray:
            return np.bincount(context[mine] * _SIZE + d[mine], n[mine], size * _SIZE).reshape(size, _SIZE)

        order0 = _step(table(np.zeros_like(d), 1), np.full((1, _SIZE), 1 / 256))
        order1 = _step(table(c, _SIZE), order0)
        order2 = _step(table(b * _SIZE + c, _SIZE ** 2), np.tile(order1, (_SIZE, 1)))
        order3 = _step(table(third[triple].astype(np.int64), len(known)), order2[known % _SIZE ** 2])
        for out, table_ in ((short, order2), (long, order3)):
            out[:, k] = np.minimum(-np.log2(np.maximum(table_, 2.0 ** -60)) * _SCALE, 65535).astype(np.uint16).ravel()
    return LanguageModel(languages, code, third, short, long)


def lengths(texts: list[bytes], model: LanguageModel) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(texts), len(model.languages)))
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) < 1 << 20):
            size += len(texts[stop]) + 3
            stop += 1
        part = texts[start:stop]
        flat = model.code[np.frombuffer(_PAD + _PAD.join(part), np.uint8)]
        pair = (flat[:-2] << 14) | (flat[1:-1] << 7) | flat[2:]  # window of three
        number = model.third[pair[:-1]]
        known = number >= 0
        cost = np.where(known[:, None], model.long[np.where(known, number, 0) * _SIZE + flat[3:]], model.short[pair[1:]])
        total = np.concatenate([np.zeros((1, cost.shape[1]), np.int64), np.cumsum(cost, axis=0, dtype=np.int64)])
        size = np.array([len(t) for t in part])
        first = np.concatenate([[0], np.cumsum(size + 3)[:-1]])
        out[start:stop] = (total[first + size] - total[first]) / _SCALE
        start = stop
    return out


def _letters(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text.decode(errors="replace")))


def _predict(model: LanguageModel):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not model.languages:
                yield to_batch({"doc_id": batch.column("doc_id"), "lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts), "bits_per_byte": [None] * len(texts)}, schema)
                continue
            bits = lengths(texts, model)
            best = bits.argmin(axis=1)
            least = bits.min(axis=1)
            share = 1 / np.exp2(-np.minimum(bits - least[:, None], 200)).sum(axis=1)
            letters = np.array([_letters(t) for t in texts], bool)
            yield to_batch({
                "doc_id": batch.column("doc_id"),
                "lang_pred": [model.languages[k] if ok else "und" for k, ok in zip(best, letters)],
                "score": np.where(letters, share, 0.0),
                "bits_per_byte": [float(x) / len(t) if t else None for x, t in zip(least, texts)],
            }, schema)

    return run


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Train on the whole texts of at most ``documents`` rows per language of ``docs(doc_id, text, lang)``.

    Rows without a text or language are not used. Only counts of four-byte
    windows reach the driver.
    """
    named = docs.where("lang is not null and text is not null").select(
        F.col("doc_id"), F.col("lang").cast("string").alias("lang"), raw_text(F.col("text")).alias("text"))
    turn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # The first of each slice of a language, then the first of those: no task orders a whole language.
    part = Window.partitionBy("lang", "slice").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = named.select("doc_id", "lang").withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(_SLICES)))
    for order in (part, turn):
        picked = picked.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= params.documents)
    counts = (
        named.join(picked.select("doc_id", "lang").distinct(), ["doc_id", "lang"], "left_semi").select("lang", "text")
        .mapInArrow(_windows, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n"))
    )
    found = materialize(counts, "windows").toPandas()
    return build(list(zip(found["lang"], found["window"], found["n"])))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)`` for every row of ``docs(doc_id, text)``.

    ``score`` is the language's posterior under equal priors. Null texts and
    texts without a letter are ``und`` with score 0, as is everything under a
    model without languages. Rows that repeat an id are judged each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(F.col("text")).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, bits_per_byte double")
