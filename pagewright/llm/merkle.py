"""Merkle manifest of a dataset, its nodes in van Emde Boas order.

Every document is a leaf. Per source, and then over the sources, every 16
consecutive nodes become their hash, until one is left. Aligned subtrees of
4,096 leaves are blocks: one task hashes one, and stores its nodes as subtrees
split at half height again and again, each in one piece, so that a walk to the
root touches few pieces whatever their size. The roots of blocks are the leaves
of the blocks above them. All places in a block are computed, none are stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import to_batch
from pagewright.session import materialize

_BITS = 4
_RUN = 1 << _BITS  # nodes hashed together
_LEVELS = 3  # hashing steps of a block
_BLOCK = _RUN ** _LEVELS
_FIELDS = ("doc_id", "source", "lang", "n_chars")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def level_counts(n: int, alone: bool = True) -> list[int]:
    """Nodes on each level over ``n`` leaves: to a single one, or as high as blocks below others go."""
    counts = [n]
    while (counts[-1] > 1) if alone else (len(counts) <= _LEVELS):
        counts.append(-(-counts[-1] // _RUN))
    return counts


def _full(levels: int) -> int:
    return sum(_RUN ** k for k in range(levels))


def address(counts: list[int], level: int, index: np.ndarray, low: int = 0, high: int | None = None, root: np.ndarray | int = 0) -> np.ndarray:
    """Place of the nodes ``index`` of ``level`` in the tree of the levels ``low`` to ``high`` under ``root``.

    The upper half of the levels comes first, then each tree of the lower half,
    from left to right; all are laid out in the same way. Only the last node of
    a level may lack children, so trees further left are full.
    """
    high = len(counts) - 1 if high is None else high
    if low == high:
        return np.zeros_like(index)
    middle = low + (high - low + 1) // 2
    if level >= middle:
        return address(counts, level, index, middle, high, root)
    upper = sum(np.clip(counts[k] - (root << _BITS * (high - k)), 0, _RUN ** (high - k)) for k in range(middle, high + 1))
    own = index >> _BITS * (middle - 1 - level)
    earlier = own - (root << _BITS * (high - middle + 1))
    return upper + earlier * _full(middle - low) + address(counts, level, index, low, middle - 1, own)


def layout(leaves: list[bytes], alone: bool) -> bytes:
    """Nodes over ``leaves`` in van Emde Boas order, 32 bytes each; the root is the first."""
    counts, level = level_counts(len(leaves), alone), leaves
    out = np.empty((sum(counts), 32), np.uint8)
    for k in range(len(counts)):
        if k:
            texts = [node.hex().encode() for node in level]
            level = [hashlib.sha256(b"".join(texts[i:i + _RUN])).digest() for i in range(0, len(texts), _RUN)]
        out[address(counts, k, np.arange(counts[k]))] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
    return out.tobytes()


def siblings(nodes: bytes, n: int, alone: bool) -> list[list[bytes]]:
    """For each level below the root: its nodes as hex text, in order, found by their computed places."""
    counts = level_counts(n, alone)
    table = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    return [[node.tobytes().hex().encode() for node in table[address(counts, k, np.arange(counts[k]))]] for k in range(len(counts) - 1)]


def steps(levels: list[list[bytes]], index: int) -> list[tuple[bytes, bytes]]:
    """Hex text of the siblings left and right of leaf ``index`` and of its ancestors."""
    out = []
    for level in levels:
        start = index & -_RUN
        out.append((b"".join(level[start:index]), b"".join(level[index + 1:start + _RUN])))
        index >>= _BITS
    return out


def climb(node: str, path: list[tuple[bytes, bytes]]) -> str:
    for left, right in path:
        node = hashlib.sha256(left + node.encode() + right).hexdigest()
    return node


_BLOCKS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("n", pa.int64()), ("nodes", pa.binary()),
                     ("root", pa.binary()), ("ids", pa.list_(pa.int64())), ("claims", pa.list_(pa.binary()))])
_BLOCK_SQL = "tree string, block long, total long, n long, nodes binary, root binary, ids array<long>, claims array<binary>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one block at a time, at most ``_BLOCK``."""
    parts, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        trees, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "block"))
        cuts = np.flatnonzero((trees[1:] != trees[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if parts and (trees[a], blocks[a]) != last:
                yield pa.Table.from_batches(parts)
                parts = []
            last = trees[a], blocks[a]
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _runs(batches):
        total = rows["total"][0].as_py()
        nodes = layout(rows["digest"].to_pylist(), total <= _BLOCK)
        yield to_batch({"tree": [rows["tree"][0].as_py()], "block": [rows["block"][0].as_py()], "total": [total], "n": [len(rows)],
                        "nodes": [nodes], "root": [nodes[:32]], "ids": [rows["id"].to_pylist()], "claims": [rows["claim"].to_pylist()]}, _BLOCKS)


def ranked(rows: DataFrame) -> DataFrame:
    """``rows(tree, id, digest, claim)`` with ``rank`` in their tree, by id and digest, and ``total``, its size.

    Rows are dealt by ranges, so that a large tree, and rows that repeat an id,
    go to many tasks; each numbers its own, and adds those in earlier ranges.
    """
    order = ["tree", F.asc_nulls_first("id"), "digest", "_row"]
    part = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    numbered = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(numbered.drop("_row").select("*", part.alias("_part"), local.alias("_local")), "merkle-order")
    sizes = stored.groupBy("tree", "_part").agg(F.count("*").alias("_rows"), F.min("_local").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.sum("_rows").over(Window.partitionBy("tree")).alias("total"))
    return stored.join(offsets, ["tree", "_part"]).select("tree", "id", "digest", "claim", (F.col("_local") + F.col("_shift")).alias("rank"), "total")


def _tier(rows: DataFrame, number: int) -> DataFrame:
    dealt = rows.withColumn("block", F.floor(F.col("rank") / _BLOCK)).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    return materialize(dealt.select("tree", "block", "total", "digest", "id", "claim").mapInArrow(_hash_blocks, _BLOCK_SQL), f"merkle-{number}")


def tiers(rows: DataFrame) -> list[DataFrame]:
    """Tables of blocks over ``rows(tree, rank, total, digest, id, claim)``, the leaves' first.

    Trees that one block holds end there; of the others the roots of the blocks
    go on, a 4,096th of the rows each time.
    """
    out = [_tier(rows, 0)]
    while (out[-1].agg(F.max("total")).first()[0] or 0) > _BLOCK:
        roots = out[-1].where(F.col("total") > _BLOCK).select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("total") / _BLOCK).alias("total"), F.col("root").alias("digest"),
            F.col("block").alias("id"), F.lit(None).cast("binary").alias("claim"))
        out.append(_tier(roots, len(out)))
    return out


@dataclass(frozen=True)
class Manifest:
    """Blocks of the sources' trees and of the tree over their roots, tier by tier from the leaves.

    Trees are named by ``-`` for no source, or ``s`` and the source; the one over
    them by ``""``, with their place in it as ids, and ``places`` has their names.
    """

    sources: list[DataFrame]
    roots: list[DataFrame]
    places: DataFrame


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """The leaf of a document with this text, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(F.col(c)) for c in _FIELDS), field(text)), 256))


def lower_cased(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def leaves(docs: DataFrame, changed: Column | None = None, text: Column | None = None) -> DataFrame:
    """``(tree, id, digest, claim)`` of ``documents``; ``claim`` is the leaf with ``text`` where ``changed``, else null."""
    own = leaf(F.col("text"))
    claim = F.lit(None).cast("binary") if changed is None else F.when(changed, leaf(text))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), own.alias("digest"), claim.alias("claim"))


def build_manifest(rows: DataFrame) -> Manifest:
    """The manifest of ``leaves``; any number of rows and sources."""
    sources = tiers(ranked(materialize(rows, "merkle-leaves")))
    done = [t.where(F.col("total") <= _BLOCK).select("tree", "root") for t in sources]
    subroots = done[0]
    for more in done[1:]:
        subroots = subroots.unionByName(more)
    # The tree over the sources sorts them by name, so their place is the rank.
    named = ranked(subroots.select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("id"), F.col("tree").cast("binary").alias("digest"), F.col("root").alias("claim")))
    named = materialize(named, "merkle-places")
    top = named.select("tree", "rank", "total", F.col("claim").alias("digest"), F.col("rank").alias("id"), F.lit(None).cast("binary").alias("claim"))
    return Manifest(sources, tiers(top), named.select(F.col("digest").cast("string").alias("name"), "rank"))


_PATH = pa.list_(pa.binary())
_ABOVE = pa.schema([("tree", pa.string()), ("id", pa.int64()), ("path", _PATH), ("top", pa.list_(pa.binary()))])
_ABOVE_SQL = "tree string, id long, path array<binary>, top array<binary>"


def _pairs(path: list[bytes] | None) -> list[tuple[bytes, bytes]]:
    path = path or []
    return list(zip(path[::2], path[1::2]))


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of a block's leaves to the root, from the block's own."""
    for batch in batches:
        for row in batch.to_pylist():
            levels, above = siblings(row["nodes"], row["n"], row["total"] <= _BLOCK), row["path"] or []
            top = [*(row["top"] or []), row["root"]] if row["total"] <= _BLOCK else row["top"]
            paths = [[x for pair in steps(levels, i) for x in pair] + above for i in range(row["n"])]
            yield to_batch({"tree": [row["tree"]] * row["n"], "id": row["ids"], "path": paths, "top": [top] * row["n"]}, _ABOVE)


_PROOF = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            alone = row["total"] <= _BLOCK
            levels, above = siblings(row["nodes"], row["n"], alone), _pairs(row["path"])
            root, *subroot = (x.hex() for x in row["top"])
            subroot = row["root"].hex() if alone else subroot[0]
            rest = b"".join(x for pair in above for x in pair)
            index = np.arange(row["n"])
            own = np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32)[address(level_counts(row["n"], alone), 0, index)]
            found, known = [], {}
            for i in range(row["n"]):
                path, mine = steps(levels, i), own[i].tobytes().hex()
                claim = row["claims"][i]
                top = climb(mine if claim is None else claim.hex(), path)
                if top not in known:
                    known[top] = climb(top, above)
                proof = hashlib.sha256(b"".join(x for pair in path for x in pair) + rest).hexdigest()
                found.append((row["ids"][i], mine, subroot, root, proof, known[top], known[top] == root))
            yield to_batch(dict(zip(_PROOF.names, zip(*found))), _PROOF)


def audit(manifest: Manifest) -> DataFrame:
    """One row for each leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` hashes the siblings on the leaf's way to the root, level by
    level. ``folded_root`` is the root that the claimed leaf, or the leaf itself
    where nothing is claimed, gives with these siblings; ``verified`` says
    whether it is the root.

    Leaves of a source go by doc_id, null first, then by their hash. Rows that
    repeat an id are leaves of their own. Nulls in any column are hashed as
    such; very long texts are hashed like others. Columns a leaf does not have
    are ignored. An empty table has no root and gives no rows.
    """
    above = None
    for tier in reversed(manifest.roots):
        above = _below(tier, above)
    named = above.join(manifest.places.withColumnRenamed("rank", "id"), "id").select(F.col("name").alias("tree"), "path", "top")
    above = None
    for tier in reversed(manifest.sources[1:]):
        above = _below(_with_paths(tier, named, above), None)
    return _with_paths(manifest.sources[0], named, above).mapInArrow(
        _prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _with_paths(tier: DataFrame, named: DataFrame, above: DataFrame | None) -> DataFrame:
    """Blocks with the path from their root: from the tree over the sources, or from the blocks above."""
    ends = tier.where(F.col("total") <= _BLOCK).join(named, "tree")
    if above is None:
        return ends
    inner = tier.where(F.col("total") > _BLOCK).join(above.withColumnRenamed("id", "block"), ["tree", "block"])
    return ends.unionByName(inner)


def _below(tier: DataFrame, above: DataFrame | None) -> DataFrame:
    if "path" not in tier.columns:
        tier = (tier.withColumns({"path": F.array().cast("array<binary>"), "top": F.array().cast("array<binary>")}) if above is None
                else tier.join(above.withColumnRenamed("id", "block"), ["tree", "block"]))
    return materialize(tier.mapInArrow(_descend, _ABOVE_SQL), "merkle-paths")
