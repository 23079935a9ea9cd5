"""Toxicity by a subsequence string-kernel support vector machine.

A sentence is as toxic as its most toxic segment: a word, or single letters
that stand in a row. A document is judged by its most toxic segment and by the
mean of its three most toxic different ones, values beyond the machine's margin
cut to it. Segments are compared by the gap-weighted subsequence
kernel, which sees the same three letters in the same order through gaps and
inserted characters. Nystroem landmarks make the kernel a feature map of fixed
size; a linear machine is trained in it. Its decision function is linear in
the kernel's own space too, so it folds into one weight for each letter triple,
and a segment's score is a sum of those weights.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import raw_text, to_batch
from pagewright.session import materialize

_CACHED = 400_000
_BITS = 6
_LETTERS = re.compile(r"[^\W\d_]+")
_LONE = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][^\w\n]{1,3}){2,}[^\W\d_](?![^\W\d_])")
_SENTENCE = re.compile(r"[^.!?\n]+")
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_CUT = 1.0  # values beyond it count as it: the machine is sure
_cache: dict[bytes, dict[str, float]] = {}


@dataclass(frozen=True)
class ToxicityParams:
    """``labelled`` bounds the labelled documents, ``positives``, ``negatives`` and ``landmarks`` bound the segments the machine is fitted on, each with all its windows;
    which segments tell toxic documents apart is counted over all these documents.
    A telling one stands in ``least_places`` different places of them, with log odds of ``least_odds``."""

    decay: float = 0.7
    window: int = 10
    step: int = 2
    landmarks: int = 192
    labelled: int = 30_000
    positives: int = 3000
    negatives: int = 12000
    least_places: int = 5
    least_odds: float = 3.0
    penalty: float = 1e-4


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of letter triples, bias, and the numbers that turn a document's decisions into a probability."""

    weights: np.ndarray
    bias: float
    slope: tuple[float, float]
    offset: float
    params: ToxicityParams

    def key(self) -> bytes:
        return self.weights.tobytes()[:64] + np.array([self.bias, self.weights.sum()]).tobytes()


def segments(text: str) -> list[str]:
    """Words of letters, what runs of single letters spell, and what tokens spell without the signs and digits inside them.

    So ``mor*on`` and ``i_d_i_o_t`` are read as words too; letters that digits
    stand for are missing, which the kernel sees as a gap.
    """
    return [*words_of(text), *joined(text)]


def words_of(text: str) -> list[str]:
    """Words of letters, and what runs of single letters spell: what the machine learns from."""
    text = text.lower()
    found = _LETTERS.findall(text)
    for run in _LONE.finditer(text):
        found.append("".join(_LETTERS.findall(run.group())))
    return found


def joined(text: str) -> list[str]:
    found = []
    for token in text.lower().split():
        if not token.isalpha() and not (token := token.strip(_SIGNS)).isalpha() and len(runs := _LETTERS.findall(token)) > 1:
            found.append("".join(runs))
    return found


def _parts(words: list[str], window: int, step: int) -> tuple[list[str], np.ndarray]:
    """All windows of ``words`` and the word of each window.

    Marks stand before and after a word: many insults are known by how they begin.
    """
    parts, owner = [], []
    for i, word in enumerate(f"^{w}$" for w in words):
        for s in range(0, max(len(word) - window + step, 1), step):
            parts.append(word[s:s + window])
            owner.append(i)
    return parts, np.array(owner, np.int64)


def _codes(parts: list[str], window: int) -> np.ndarray:
    """Letters of windows as small numbers, 0 where there is none."""
    flat = np.frombuffer("".join(p.ljust(window, "\0") for p in parts).encode("utf-32-le"), "<u4").reshape(-1, window)
    small = np.where((flat >= 97) & (flat <= 122), flat - 96, 27 + flat % 37)
    return np.where(flat == 0, 0, small).astype(np.int32)


def _norms(window: int, decay: float) -> np.ndarray:
    """Length of the kernel-space vector of a window of 0, 1, 2, ... different letters."""
    squares = [sum(decay ** (2 * (k - i - 2)) for i, _, k in combinations(range(n), 3)) for n in range(window + 1)]
    return np.sqrt(np.maximum(squares, 1.0))


def _triples(codes: np.ndarray, decay: float) -> Iterator[tuple[np.ndarray, float]]:
    """Each triple of places: the letters' number, -1 where one is missing, and its weight."""
    for i, j, k in combinations(range(codes.shape[1]), 3):
        number = (codes[:, i] << 2 * _BITS) | (codes[:, j] << _BITS) | codes[:, k]
        yield np.where(codes[:, k] > 0, number, -1), decay ** (k - i - 2)


def _vectors(parts: list[str], params: ToxicityParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel-space vectors of windows: row, triple and value of what is not 0."""
    codes = _codes(parts, params.window)
    norms = _norms(params.window, params.decay)[(codes > 0).sum(axis=1)]
    rows, numbers, values = [], [], []
    for number, weight in _triples(codes, params.decay):
        at = np.flatnonzero(number >= 0)
        rows.append(at)
        numbers.append(number[at])
        values.append(weight / norms[at])
    return tuple(map(np.concatenate, (rows, numbers, values)))


def _dense(parts: list[str], known: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """The vectors' columns for the triples ``known``."""
    rows, numbers, values = _vectors(parts, params)
    at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
    hit = known[at] == numbers
    out = np.zeros((len(parts), len(known)), np.float32)
    np.add.at(out, (rows[hit], at[hit]), values[hit])
    return out


def _machine(features: np.ndarray, labels: np.ndarray, places: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps.

    Classes weigh the same; within one, a segment weighs the root of its ``places``.
    """
    x = np.hstack([features, np.ones((len(features), 1))]).astype(np.float64)
    weight = np.sqrt(places)
    for side in (labels > 0, labels < 0):
        weight[side] /= 2 * max(weight[side].sum(), 1)
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(30):
        active = labels * (x @ w) < 1
        xa, wa = x[active], weight[active][:, None]
        new = np.linalg.solve(xa.T @ (xa * wa) + ridge, xa.T @ (wa[:, 0] * labels[active]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _fit(good: dict[str, int], bad: dict[str, int], params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights of letter triples and bias from windows of clean and segments of toxic sentences.

    Every window of a clean segment is clean; of a toxic one, the window the last
    machine found most toxic is toxic, until no choice changes.
    """
    weights = np.zeros(1 << 3 * _BITS, np.float32)
    if not bad or not good:
        return weights, -1.0
    half = params.landmarks // 2
    parts, owner = _parts(list(bad), params.window, params.step)
    marks = [w for side in (dict.fromkeys(parts), good) for w in list(side)[:: max(1, len(side) // half)][:half]]
    known = np.unique(_vectors(marks, params)[1])
    if not len(known):
        return weights, -1.0
    dense = _dense(marks, known, params)
    values, vectors = np.linalg.eigh((dense @ dense.T).astype(np.float64))
    keep = values > 1e-3 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    every = [*parts, *good]
    x = np.concatenate([_dense(every[i:i + 2000], known, params) @ dense.T for i in range(0, len(every), 2000)]) @ root
    clean = np.arange(len(parts), len(every))
    places = np.concatenate([np.array(list(bad.values()), float)[owner], np.array(list(good.values()), float)])
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    chosen, tried = np.arange(len(parts)), set()
    while chosen.tobytes() not in tried:
        tried.add(chosen.tobytes())
        used = np.concatenate([chosen, clean])
        w, bias = _machine(x[used], np.where(used < len(parts), 1, -1), places[used], params.penalty)
        # The most toxic window of each segment; the first of equal ones.
        chosen = np.lexsort((np.arange(len(parts)), -(x[:len(parts)] @ w), owner))[first]
    weights[known] = (root @ w) @ dense
    return weights, bias


def decisions(words: list[str], model: ToxicityModel) -> np.ndarray:
    """The machine's value of each word: that of its most toxic window."""
    parts, owner = _parts(words, model.params.window, model.params.step)
    out = np.full(len(words), -np.inf, np.float32)
    np.maximum.at(out, owner, _values(parts, model))
    return out


def _values(parts: list[str], model: ToxicityModel) -> np.ndarray:
    """The machine's value of each window."""
    codes = _codes(parts, model.params.window)
    total = np.zeros(len(codes), np.float32)
    padded = np.append(model.weights, np.float32(0))
    size = (codes > 0).sum(axis=1)
    longest = int(size.max()) if len(codes) else 0
    for number, weight in _triples(codes[:, :longest], model.params.decay):
        total += np.float32(weight) * padded[number]
    return total / _norms(model.params.window, model.params.decay)[size] + np.float32(model.bias)


def _known(words: set[str], model: ToxicityModel) -> dict[str, float]:
    """The values of ``words`` and of others met before; those of one model are kept, as a worker outlives its task."""
    if (key := model.key()) not in _cache:
        _cache.clear()
    cache = _cache.setdefault(key, {})
    new = [w for w in words if w not in cache]
    if len(cache) + len(new) > _CACHED:
        cache.clear()
        new = list(words)
    by_length = sorted(new, key=len)
    for start in range(0, len(by_length), 4000):
        part = by_length[start:start + 4000]
        cache.update(zip(part, decisions(part, model).tolist()))
    return cache


def _scorer(model: ToxicityModel, with_sentence: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("best", pa.float64()), ("mean", pa.float64())] + [("sentence", pa.string())] * with_sentence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column("text").to_pylist()
                found = [set(segments(t)) for t in texts]
                cache = _known(set().union(*found), model)
                top = [[min(v, _CUT) for v in heapq.nlargest(3, (*map(cache.__getitem__, f), *[model.bias] * 3))] for f in found]
                out = {"doc_id": batch.column("doc_id"), "best": [t[0] for t in top], "mean": [sum(t) / 3 for t in top]}
                if with_sentence:
                    out["sentence"] = [
                        max(_SENTENCE.findall(t), default=None,
                            key=lambda s: max((cache.get(w, model.bias) for w in segments(s)), default=model.bias)) for t in texts]
                yield to_batch(out, schema)

    return run


def _windows(model: ToxicityModel):
    schema = pa.schema([("part", pa.string()), ("good", pa.int64()), ("decision", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, owner = _parts(batch.column("segment").to_pylist(), model.params.window, model.params.step)
            for at in range(0, len(parts), 4000):
                good = batch.column("good").to_numpy()[owner[at:at + 4000]]
                yield to_batch({"part": parts[at:at + 4000], "good": good, "decision": _values(parts[at:at + 4000], model)}, schema)

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's segments with a number for the segment before."""
    schema = pa.schema([("toxic", pa.int32()), ("segment", pa.string()), ("after", pa.int64())])
    for batch in batches:
        rows = []
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            found = words_of(text)
            rows += [(toxic, w, zlib.crc32(v.encode())) for v, w in set(zip(["", *found], found))]
        yield to_batch(dict(zip(schema.names, zip(*rows))) if rows else dict.fromkeys(schema.names, ()), schema)


def labelled_documents(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Texts and labels of at most ``labelled`` rows of ``labels(doc_id, toxic)``, the first by a hash of their id."""
    picked = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(params.labelled)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``labelled`` pairs of numbers


def fit(labelled: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on ``labelled(text, toxic)``; rows without a label of 0 or 1 are ignored.

    Segments are counted per label over all rows, each once for every segment it
    follows, so that copies of a document count once. At most
    ``positives`` telling and ``negatives`` other segments reach the machine,
    the others half by frequency and half by hash. Without both labels the
    model gives every text a score near 0.
    """
    rows = labelled.where("toxic in (0, 1)").select(F.col("toxic").cast("int").alias("toxic"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad_docs, good_docs = sizes.get(1, 0), sizes.get(0, 0)
    counts = (
        rows.mapInArrow(_split, "toxic int, segment string, after long").groupBy("segment", "after")
        .agg(F.max("toxic").alias("bad"), F.max(1 - F.col("toxic")).alias("good"))
        .groupBy("segment").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    counts = materialize(counts, "segments")
    total = counts.agg(F.sum("bad"), F.sum("good")).first()
    odds = F.log((F.col("bad") + 0.5) / ((total[0] or 0) + 1)) - F.log((F.col("good") + 0.5) / ((total[1] or 0) + 1))
    counts = counts.withColumn("odds", odds)
    telling = (F.col("bad") >= params.least_places) & (F.col("odds") >= params.least_odds) & (F.length("segment") > 2)
    bad = dict(map(tuple, counts.where(telling).orderBy(F.desc(F.col("odds") * F.col("bad")), "segment").limit(params.positives).select("segment", "bad").collect()))
    plain = counts.where((F.col("odds") < 0.7) & (F.col("good") > 0))
    half = params.negatives // 2
    good = {}
    for order in (F.desc("good"), F.xxhash64("segment")):
        good |= dict(map(tuple, plain.orderBy(order, "segment").limit(half).select("segment", "good").collect()))
    parts, owner = _parts(list(good), params.window, params.step)
    places, good = list(good.values()), {}
    for part, i in zip(parts, owner):
        good[part] = good.get(part, 0) + places[i]
    weights, bias = _fit(good, bad, params)
    # The clean windows this machine finds most toxic join the others.
    hard = (
        plain.select("segment", "good").mapInArrow(_windows(ToxicityModel(weights, bias, (1.0, 0.0), 0.0, params)), "part string, good long, decision double")
        .groupBy("part").agg(F.sum("good").alias("good"), F.max("decision").alias("decision"))
        .orderBy(F.desc("decision"), "part").limit(half).select("part", "good")
    )
    good |= dict(map(tuple, hard.collect()))
    weights, bias = _fit(good, bad, params)
    raw = ToxicityModel(weights, bias, (1.0, 0.0), 0.0, params)
    # Platt's sigmoid on a histogram of all labelled documents' decisions.
    bins = (
        rows.select(F.col("toxic").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(raw, False), "doc_id long, best double, mean double")
        .groupBy("doc_id", *(F.round(F.greatest(F.least(c, F.lit(10.0)), F.lit(-10.0)), 1).alias(c) for c in ("best", "mean"))).count().collect()
    )
    at = np.array([(r["best"], r["mean"]) for r in bins] or [(0.0, 0.0)])
    y = np.array([r["doc_id"] for r in bins] or [0])
    n = np.array([r["count"] for r in bins] or [0], float)
    slope, offset = _sigmoid(at, (y * (bad_docs + 1) + (1 - y)) / (np.where(y == 1, bad_docs, good_docs) + 2), n)
    return ToxicityModel(weights, bias, slope, offset, params)


def _sigmoid(x: np.ndarray, target: np.ndarray, n: np.ndarray) -> tuple[tuple[float, float], float]:
    """Logistic regression of ``target`` on ``x`` with counts ``n`` and a small ridge."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.array([1.0, 1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (n * (p - target)) + 1e-2 * w
        curve = (z * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-2 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])), float(w[2])


def score(docs: DataFrame, model: ToxicityModel, with_sentence: bool = False) -> DataFrame:
    """``(doc_id, score)`` and, on demand, the most toxic ``sentence``, for every row of ``docs(doc_id, text)``.

    Null, empty and letterless texts get the score of a text without evidence.
    Rows that repeat an id are scored each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(_scorer(model, with_sentence), "doc_id long, best double, mean double" + ", sentence string" * with_sentence)
    value = 1 / (1 + F.exp(-(F.col("best") * model.slope[0] + F.col("mean") * model.slope[1] + model.offset)))
    return found.select("doc_id", value.alias("score"), *["sentence"] * with_sentence)


def clean_documents(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score below ``threshold``, unchanged."""
    scorer = _scorer(model, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([t or "" for t in batch.column("text").to_pylist()], pa.string())
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), texts], ["doc_id", "text"])
            parts = list(scorer([rows]))
            if parts:
                best, mean = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("best", "mean"))
                value = 1 / (1 + np.exp(-(best * model.slope[0] + mean * model.slope[1] + model.offset)))
                yield batch.filter(pa.array(value < threshold))

    return docs.mapInArrow(run, docs.schema)
