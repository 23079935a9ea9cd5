"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words: the ASCII characters of Python's bytes.split().
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32`` of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


def raw_text(text: Column) -> Column:
    """The text's UTF-8 bytes, empty for null."""
    return F.coalesce(text.cast("string").cast("binary"), F.lit(b""))


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null."""
    parts = F.size(F.split(text, SPACE + "+"))
    ends = F.when(text.rlike(rf"\A{SPACE}"), 1).otherwise(0) + F.when(text.rlike(rf"{SPACE}\z"), 1).otherwise(0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(parts - ends).cast("long")


def to_batch(columns: dict[str, Iterable], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows and about ``size`` in the jobs run inside; then the session's own again.

    Long texts and packed arrays else fill batches of many megabytes, which the
    JVM and the Python worker of every core hold at once.
    """
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of each run of rows with equal keys.

    The input is sorted by ``keys``; a run may span batches. Holds one batch
    and one run at a time, so callers bound the size of a run.
    """
    parts: list[dict[str, np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            change[1:] |= columns[key][1:] != columns[key][:-1]
        starts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            here = tuple(columns[k][a] for k in keys)
            if parts and here != last:
                yield _joined(parts)
                parts = []
            last = here
            parts.append({n: v[a:b] for n, v in columns.items()})
    if parts:
        yield _joined(parts)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def block_pairs(rows: DataFrame, size: str, member: Column, most: int) -> DataFrame:
    """Split groups larger than ``most`` into blocks, and every row into each pair of blocks it is part of.

    Adds ``block_a <= block_b`` and ``own``, the row's block. A group of n rows
    makes n / most copies of each row; groups up to ``most`` are not copied.
    """
    blocks = F.ceil(F.col(size) / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(17)), blocks.cast("long")).cast("int")
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("block_a", F.least("own", "other"))
        .withColumn("block_b", F.greatest("own", "other"))
        .drop("other")
    )
