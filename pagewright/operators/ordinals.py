"""Numbering rows without pulling a group or the whole set into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import materialize


def ordinal_in_group(df: DataFrame, group: str, order: str, name: str, width: int = 65_536) -> DataFrame:
    """Zero-based position of each row in its group, and the group size ``n``.

    ``order`` must be a unique and fairly dense integer, such as a row id; sparse
    ids would make a slice of every row. Rows are numbered inside slices of
    ``width`` consecutive order values, so a slice holds at most ``width`` rows
    however large its group is; running totals over the slice counts then
    shift the slices into place.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width))
    counts = sliced.groupBy(group, "_slice").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(group)
    offsets = counts.select(
        group, "_slice",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("n"),
    )
    local = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(order)) - 1
    numbered = sliced.withColumn("_local", local)
    placed = numbered.join(offsets, [group, "_slice"])
    return placed.withColumn(name, F.col("_before") + F.col("_local")).drop(
        "_slice", "_local", "_before"
    )


def global_ordinal(df: DataFrame, order: list, name: str) -> DataFrame:
    """One-based position of each row in the order of the whole set.

    Range partitioning sorts the rows across tasks; each partition numbers its
    own rows and adds the sizes of the partitions before it. The ranged rows
    are written once because sampling may cut the ranges differently when
    recomputed.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    local = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    stored = materialize(
        ranged.select("*", part.alias("_part"), local.alias("_local")), f"order-{name}"
    )
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_rows"))
    # One row per shuffle partition: small by construction.
    before = F.coalesce(
        F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    offsets = sizes.select("_part", before.alias("_before"))
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_local") + 1)
        .drop("_part", "_local", "_before")
    )


def number_top(df: DataFrame, order: list, limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows in order, numbered from one.

    Each task keeps its own first ``limit`` rows, and only those meet in one
    task, so the limit must be one that a task can hold.
    """
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
