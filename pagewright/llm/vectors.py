"""Embedding near-duplicates by spherical-cap filters.

Filter directions are structured: a direction is a choice of one unit vector
from each block's random codebook, after a random rotation. A vector belongs to
the filters whose directions it exceeds; because a direction's product is a sum
over blocks, these are found by list decoding, block by block, without going
through all directions. Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import block_pairs, sorted_runs, to_batch
from pagewright.llm.components import connected_components
from pagewright.session import materialize


@dataclass(frozen=True)
class CapParams:
    """``level``: a vector exceeds a direction if the product is at least this many standard
    deviations, or as large as the vector's ``fewest`` best ones. At 2 blocks of 64 there are
    4,096 directions; a vector exceeds about 40 of them and shares one with all but a
    vanishing part of the vectors at ``cosine``."""

    cosine: float = 0.93
    blocks: int = 2
    codes: int = 64
    level: float = 2.4
    fewest: int = 32
    block: int = 1024
    seed: int = 11


class _Code:
    def __init__(self, size: int, params: CapParams):
        rng = np.random.default_rng((params.seed, size))
        self.turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        self.parts = np.array_split(np.arange(size), min(params.blocks, size))
        self.books = []
        for part in self.parts:
            book = rng.standard_normal((params.codes, len(part)))
            book /= np.linalg.norm(book, axis=1, keepdims=True)
            self.books.append(book * np.sqrt(len(part) / size))
        self.least = params.level / np.sqrt(size)
        self.base = params.codes
        self.fewest = params.fewest

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Per unit vector the sorted numbers of all filters it exceeds, and of its ``fewest`` best ones."""
        turned = unit @ self.turn
        values = [turned[:, part] @ book.T for part, book in zip(self.parts, self.books)]
        best_left = np.cumsum([v.max(axis=1) for v in values[::-1]], axis=0)[::-1]
        found = []
        for i in range(len(unit)):
            top = np.zeros(1)
            for value in values:
                top = np.sort((top[:, None] + np.sort(value[i])[None, -self.fewest:]).ravel())[-self.fewest:]
            least = min(self.least, top[0]) - 1e-12
            sums, numbers = np.zeros(1), np.zeros(1, np.int64)
            for depth, value in enumerate(values):
                order = np.argsort(-value[i])
                ahead = best_left[depth + 1][i] if depth + 1 < len(values) else 0.0
                grown = sums[:, None] + value[i][order][None, :]
                keep = grown + ahead >= least
                numbers = (numbers[:, None] * self.base + order[None, :])[keep]
                sums = grown[keep]
            found.append(np.sort(numbers))
        return found


def _filters(params: CapParams):
    schema = pa.schema([("class", pa.int64()), ("filters", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, _Code] = {}
        for batch in batches:
            vectors = batch.column("vector").to_numpy(zero_copy_only=False)
            found: list = [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors], np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                unit = np.stack([vectors[i] for i in at])
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                if size not in codes:
                    codes[size] = _Code(int(size), params)
                for i, numbers in zip(at, codes[size].decode(unit)):
                    found[i] = numbers
            yield to_batch({"class": batch.column("class"), "filters": found}, schema)

    return run


def _links(params: CapParams):
    """Partial link counts and spanning edges of each group of vectors that share a filter.

    A pair counts where the filter is its first common one, so each counts once.
    Edges are those of the pairs' components inside the group: at most one per row.
    """
    schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_runs(batches, ["label", "size", "filter", "block_a", "block_b"]):
            own, ids, times = rows["own"], rows["class"], rows["times"]
            left = np.flatnonzero(own == rows["block_a"][0])
            right = np.flatnonzero(own == rows["block_b"][0])
            if not len(left) or not len(right) or len(ids) < 2:
                continue
            vectors = np.stack(list(rows["vector"])).astype(np.float64)
            norms = np.sqrt((vectors * vectors).sum(axis=1))
            near = (vectors[left] @ vectors[right].T) / np.outer(norms[left], norms[right]) >= params.cosine
            if rows["block_a"][0] == rows["block_b"][0]:
                near &= ~np.eye(len(left), dtype=bool)
            near &= ids[left][:, None] != ids[right][None, :]
            x, y = np.nonzero(near)
            if not len(x):
                continue
            first = near.copy()
            used = np.union1d(left[np.unique(x)], right[np.unique(y)])
            lists = [f[: np.searchsorted(f, rows["filter"][0])] for f in (rows["filters"][i] for i in used)]
            known, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(used)), [len(f) for f in lists])
            place_l, place_r = np.searchsorted(used, left), np.searchsorted(used, right)
            has_l = np.isin(left, used)
            has_r = np.isin(right, used)
            shared = np.flatnonzero(count > 1)
            for start in range(0, len(shared), 1024):
                part = shared[start:start + 1024]
                slot = np.full(len(known), -1)
                slot[part] = np.arange(len(part))
                table = np.zeros((len(used), len(part)), np.float32)
                hit = slot[column] >= 0
                table[owner[hit], slot[column[hit]]] = 1
                earlier = table[place_l[has_l]] @ table[place_r[has_r]].T > 0
                first[np.ix_(has_l, has_r)] &= ~earlier
            counts = np.zeros(len(ids), np.int64)
            np.add.at(counts, left, (first * times[right][None, :]).sum(axis=1))
            if rows["block_a"][0] != rows["block_b"][0]:
                np.add.at(counts, right, (first * times[left][:, None]).sum(axis=0))
            root = ids.copy()  # smallest class reachable through ``near``
            while True:
                new = root.copy()
                np.minimum.at(new, left[x], root[right[y]])
                np.minimum.at(new, right[y], root[left[x]])
                if (new == root).all():
                    break
                root = new
            yield to_batch({"class": ids[used], "n": counts[used], "to": root[used]}, schema)

    return run


def similar_vectors(vectors: DataFrame, params: CapParams = CapParams()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors(vec_id, embedding, label)``.

    Vectors link when their labels are equal and not null, their lengths are
    equal and their cosine is at least ``cosine``. Vectors that are null, empty,
    zero or hold null or non-finite numbers link with nothing. Equal vectors of
    a label are one class, compared once; each row still counts all others.
    Rows without an id are left out of links and keep a null component. Other
    columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    good = (
        (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.when(F.coalesce(good, F.lit(False)), v).alias("vector"))
    rows = materialize(rows.withColumn("print", F.when(F.col("vector").isNotNull(), F.struct("label", F.md5(F.to_json("vector"))))), "vectors")
    classes = materialize(
        rows.where("vector is not null").groupBy("print")
        .agg(F.min("vec_id").alias("class"), F.count("*").alias("times"), F.first("vector").alias("vector"), F.first("label").alias("label"))
        .withColumn("size", F.size("vector")), "classes")
    filters = materialize(classes.select("class", "vector").repartition("class").mapInArrow(_filters(params), "class long, filters array<long>"), "filters")
    member = classes.join(filters, "class")
    placed = member.select("class", "label", "size", F.explode("filters").alias("filter"))
    many = placed.groupBy("label", "size", "filter").agg(F.count("*").alias("n")).where("n > 1")
    shared = placed.join(many, ["label", "size", "filter"]).join(member.select("class", "vector", "times", "filters"), "class")
    group = ["label", "size", "filter", "block_a", "block_b"]
    found = materialize(
        block_pairs(shared, "n", F.col("class"), params.block).repartition(*group).sortWithinPartitions(*group)
        .mapInArrow(_links(params), "class long, n long, to long"), "links")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    groups = connected_components(found.select(F.col("class").alias("a"), F.col("to").alias("b")))
    facts = (
        classes.select("print", "class", "times").join(counts, "class", "left")
        .join(groups.withColumnRenamed("node", "class"), "class", "left")
        .select("print", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "class").alias("component"))
    )
    return (
        rows.select("vec_id", "print").join(facts, "print", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
