"""MinHash near-duplicates over word shingles.

Many universal hash minima per document, banded into candidate buckets, checked
by their signatures, confirmed on the full shingle sets, and joined into groups
by alternating large-star and small-star.

Documents with equal sets are one class, compared once. Candidates of a bucket
are first compared with the bucket's hubs; what those links join needs no more
comparison. After that only pairs between different groups of a bucket are
compared, in blocks of bounded size: by signature, then by set. A block returns
a forest that spans its links, at most one link per row, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from pagewright.llm.common import block_pairs, raw_text, sorted_runs, to_batch
from pagewright.llm.components import connected_components
from pagewright.session import materialize

_SKETCH = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()),
    ("signature", pa.binary()), ("bands", pa.list_(pa.int64())),
])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@dataclass(frozen=True)
class MinHashParams:
    """``percent``: least similarity. A pair at 80 % shares no band of ``bands`` x ``rows``
    minima in 5 of 100,000 cases, at 85 % in 4 of 10 million. ``slack``: standard errors by
    which a signature's estimate may fall short before a pair is dropped unconfirmed."""

    width: int = 5
    percent: int = 85
    bands: int = 25
    rows: int = 5
    slack: float = 5.0
    hubs: int = 3
    block: int = 1024
    seed: int = 7

    def least_equal(self) -> int:
        n, s = self.bands * self.rows, self.percent / 100
        return int(np.floor(n * (s - self.slack * np.sqrt(s * (1 - s) / n))))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``, A-Z lower-cased.

    Fewer words than ``width`` make one shingle; no words make none.
    """
    words = text.lower().split()
    n = len(words)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    if not n:
        return hashes
    k = min(n, width)
    mixed = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i:n - k + 1 + i]
    return np.unique(mixed)


def _minima(hashes: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Minimum of each function ``factor * x + shift`` modulo 2^64 (multiply-shift, top 32 bits)."""
    least = np.full(len(factor), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 2048):
        part = hashes[start:start + 2048, None] * factor
        part += shift
        np.minimum(least, part.min(axis=0), out=least)
    return least >> np.uint64(32)


def _sketch(params: MinHashParams):
    n = params.bands * params.rows
    rng = np.random.default_rng(params.seed)
    factor = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, n, np.uint64)
    mix = rng.integers(0, 2**63, (params.bands, params.rows), np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 2**63, params.bands, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {f.name: [] for f in _SKETCH}
            out["doc_id"] = batch.column("doc_id")
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), params.width)
                out["n_shingles"].append(len(found))
                if not len(found):
                    for name in ("print", "signature", "bands"):
                        out[name].append(None)
                    continue
                least = _minima(found, factor, shift)
                keys = (least.reshape(mix.shape) * mix).sum(axis=1, dtype=np.uint64) ^ salt
                keys ^= keys >> np.uint64(29)
                out["print"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                out["signature"].append(least.astype(np.uint8).tobytes())
                out["bands"].append(keys.view(np.int64))
            yield to_batch(out, _SKETCH)

    return run


def _sets(width: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64())), ("short", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), width) for t in batch.column("text")]
            yield to_batch({
                "id": batch.column("doc_id"), "shingles": [f.view(np.int64) for f in found],
                "short": [f.astype(np.uint32).tobytes() for f in found]}, schema)

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    sets = a + b
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    twice = count[column] > 1
    owner, column = owner[twice], np.unique(column[twice], return_inverse=True)[1]
    out = np.zeros((len(a), len(b)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, 2048):
        lo, hi = np.searchsorted(column, (start, start + 2048))
        table = np.zeros((len(sets), min(2048, width - start)), np.float32)
        table[owner[lo:hi], column[lo:hi] - start] = 1
        out += table[:len(a)] @ table[len(a):].T
    return out


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links join what those before them do not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            keep[i] = True
    return keep


def _open_links(params: MinHashParams):
    """Links between rows of a bucket that are of different groups.

    Sets are compared by the low 32 bits of their hashes here; the links
    returned are confirmed on the full hashes afterwards.
    """
    least = params.least_equal()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, ["key", "block_a", "block_b"]):
            own, label, ids = rows["own"], rows["label"], rows["id"]
            names, of, n = np.unique(label, return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            marks = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(ids), -1)
            across = rows["block_a"][0] != rows["block_b"][0]
            # One end of a link between groups is outside the largest group.
            few = np.flatnonzero(of != n.argmax())
            for start in range(0, len(few), 64):
                part = few[start:start + 64]
                open_ = label[part][:, None] != label[None, :]
                if across:
                    open_ &= own[part][:, None] != own[None, :]
                x, y = np.nonzero(open_)
                like = np.zeros(len(x), np.int32)
                for at in range(0, len(x), 65536):
                    like[at:at + 65536] = (marks[part[x[at:at + 65536]]] == marks[y[at:at + 65536]]).sum(axis=1)
                x, y = x[like >= least], y[like >= least]
                if not len(x):
                    continue
                left, right = np.unique(x), np.unique(y)
                sets = [[np.frombuffer(rows["short"][i], np.uint32) for i in side] for side in (part[left], right)]
                both = _common(*sets)[np.searchsorted(left, x), np.searchsorted(right, y)]
                size = np.array([len(s) // 4 for s in rows["short"]])
                linked = both * 100 >= (size[part[x]] + size[y] - both) * params.percent
                a, b = ids[part[x[linked]]], ids[y[linked]]
                keep = _spanning(a, b)
                if keep.any():
                    yield to_batch({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}, _PAIR)

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(a, "a").join(b, "b")
        .select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either"))
        .where(F.col("both") * 100 >= F.col("either") * percent)
        .select("a", "b")
    )


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs(doc_id, text)``.

    ``kept`` marks the smallest id of each group. Null, empty and blank texts
    have no shingles and are groups of their own. Rows that repeat an id count as
    one document. Null ids keep a null component and are kept. Other columns of
    ``docs`` are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(F.col("text")).alias("text"))
    sketch = materialize(
        source.mapInArrow(_sketch(params), "doc_id long, n_shingles long, print binary, signature binary, bands array<long>"),
        "sketch",
    )
    copies = (
        sketch.where("print is not null").groupBy("print")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1").drop("n")
    )
    classed = materialize(
        sketch.join(copies, "print", "left").withColumn("class", F.coalesce("first", "doc_id"))
        .select("doc_id", "n_shingles", "class",
                *(F.when(F.col("doc_id") == F.col("class"), F.col(c)).alias(c) for c in ("signature", "bands"))),
        "classes",
    )
    banded = classed.where("bands is not null").select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    hubs = [F.min(F.struct(F.xxhash64("id", F.lit(k)), "id")).alias(f"hub{k}") for k in range(params.hubs)]
    buckets = (
        banded.groupBy("key").agg(F.count("*").alias("n"), *hubs).where("n > 1")
        .select("key", "n", F.array_distinct(F.array(*(f"hub{k}.id" for k in range(params.hubs)))).alias("hubs"))
    )
    shared = materialize(banded.join(buckets, "key"), "buckets")
    sets = materialize(
        source.join(shared.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
        .mapInArrow(_sets(params.width), "id long, shingles array<long>, short binary"),
        "sets",
    )
    spokes = (
        shared.select("id", F.explode("hubs").alias("hub")).where("id != hub")
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    )
    links = materialize(_confirmed(spokes, sets, params.percent), "hub-links")
    groups = connected_components(links)

    labelled = materialize(
        shared.drop("hubs").join(groups, F.col("id") == F.col("node"), "left")
        .select("key", "n", "id", F.coalesce("component", "id").alias("label")),
        "labelled",
    )
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    open_rows = labelled.join(mixed.select("key"), "key", "left_semi").join(
        classed.where("signature is not null").select(F.col("doc_id").alias("id"), "signature").dropDuplicates(["id"]), "id")
    rest = (
        block_pairs(open_rows.join(sets.select("id", "short"), "id"), "n", F.col("id"), params.block)
        .repartition("key", "block_a", "block_b").sortWithinPartitions("key", "block_a", "block_b")
        .mapInArrow(_open_links(params), "a long, b long").distinct()
    )
    more = materialize(_confirmed(rest, sets, params.percent), "links")
    final = connected_components(links.union(more)).withColumnRenamed("node", "class")
    return (
        classed.select("doc_id", "n_shingles", "class").join(final, "class", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "class").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
