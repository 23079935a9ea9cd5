"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's documents stand in a seeded order and are cut into blocks of
equal token counts, shard by shard. Sources and shards get whole blocks by
highest quotients; a cell's blocks are then taken from a seeded start, whole
passes first. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import SPACE, word_count
from pagewright.session import materialize


@dataclass(frozen=True)
class MixParams:
    """Source weights repeat in the order of names; ``most`` is the largest number of passes."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    block: int = 16
    seed: str = "mix"


def _digits(text: Column, n: int) -> Column:
    """The first ``n`` hexadecimal digits of an MD5 as a number."""
    return F.conv(F.substring(text, 1, n), 16, 10).cast("long")


def _targets(sized: DataFrame, params: MixParams) -> DataFrame:
    """Per source: size, weight and target; one row per source, so a window over all of them is small.

    With sources sorted by how soon they are full, the water level is the
    largest of the levels that result from filling the first 0, 1, 2, ... of them.
    """
    named = sized.groupBy("name").agg(F.sum("size").alias("source_size"))
    weights = F.array(*map(F.lit, params.weights))
    every = Window.partitionBy(F.lit(1))
    turn = (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("name")) - 1) % len(params.weights)
    soon = every.orderBy(F.col("full") / F.col("weight"), "name").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        named.withColumn("weight", F.get(weights, turn)).withColumn("full", F.col("source_size") * params.most)
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(soon), F.lit(0)))
                    / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(soon), F.lit(0))))
    )
    return filled.select(
        "name", "source_size",
        F.least(F.col("full").cast("double"), F.col("weight") * F.max("level").over(every)).alias("target"))


def _quotas(cells: DataFrame, params: MixParams) -> DataFrame:
    """Whole blocks of each cell by highest quotients ``share / (2 k + 1)``.

    Rounding ``share / block`` gives the seats but for a bounded shift, so only
    seats near that number compete; those before them are certain.
    """
    every = Window.partitionBy(F.lit(1))
    seats = F.floor(F.sum("share").over(every) / params.block + 0.5)
    near = (
        cells.withColumn("seats", seats)
        .withColumn("first", F.floor(F.col("share") / params.block + 0.5))
        .withColumn("shift", F.ceil(1.5 * F.count("*").over(every) * F.col("first") / F.greatest("seats", F.lit(1))) + 2)
        .withColumn("limit", F.col("blocks") * params.most)
        .withColumn("sure", F.least(F.greatest(F.col("first") - F.col("shift"), F.lit(0)), "limit"))
        .withColumn("last", F.least(F.col("first") + F.col("shift"), "limit"))
        .withColumn("open", F.col("seats") - F.sum("sure").over(every))
    )
    order = every.orderBy((F.col("share") / (2 * F.col("seat") + 1)).desc(), "name", "shard", "seat")
    won = (
        near.where((F.col("last") > F.col("sure")) & (F.col("share") > 0))
        .select("name", "shard", "share", "open", F.explode(F.sequence("sure", F.col("last") - 1)).alias("seat"))
        .withColumn("rank", F.row_number().over(order))
        .where("rank <= open").groupBy("name", "shard").agg(F.count("*").alias("won"))
    )
    return near.join(won, ["name", "shard"], "left").select(
        "name", "shard", "blocks", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Every row of ``docs(doc_id, text, source)`` with what the mix takes of it.

    Returns all columns of ``docs`` under ``doc`` (a struct) and ``size``,
    ``source_size``, ``target``, ``passes`` (whole times taken), ``head`` and
    ``tail`` (word ranges ``[from, to)`` taken once more; empty ranges are null)
    and ``taken``. Null texts have size 0; null sources form one source, last
    in order. Rows that repeat an id are mixed each. An empty table gives none.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))
    sized = materialize(
        docs.select(
            F.struct("*").alias("doc"), F.col("doc_id").alias("_id"), name.alias("name"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat_ws(":", F.lit(params.seed), F.col("doc_id").cast("string"))).alias("key"))
        .withColumn("shard", F.substring("key", 1, 1)).withColumn("part", F.substring("key", 1, 3)),
        "sized",
    )
    parts = materialize(sized.groupBy("name", "shard", "part").agg(F.sum("size").alias("part_size")), "parts")
    targets = _targets(parts.withColumnRenamed("part_size", "size"), params)
    cells = (
        parts.groupBy("name", "shard").agg(F.sum("part_size").alias("cell_size")).join(targets, "name")
        .withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("cell_size") / F.col("source_size")).otherwise(0.0))
        .withColumn("blocks", F.greatest(F.floor(F.col("cell_size") / params.block + 0.5), F.lit(1)))
    )
    cells = materialize(cells, "cells")
    blocks = F.col("blocks")  # the last one takes what is over, or is shorter
    start = F.pmod(_digits(F.md5(F.concat_ws(":", F.lit(params.seed), "name", "shard")), 8), blocks)
    begin, end = F.col("begin"), F.col("begin") + F.col("left")
    chosen = (
        _quotas(cells, params).join(cells.drop("blocks"), ["name", "shard"])
        .withColumn("passes", F.floor(F.col("quota") / blocks)).withColumn("left", F.col("quota") % blocks)
        .withColumn("begin", start)
        .select("name", "shard", "source_size", "target", "passes",
                (begin * params.block).alias("a"), F.when(end >= blocks, F.col("cell_size")).otherwise(end * params.block).alias("b"),
                (F.greatest(end - blocks, F.lit(0)) * params.block).alias("c"))
    )
    before = Window.partitionBy("name", "shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(
        parts.withColumn("base", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
        .join(chosen, ["name", "shard"]).drop("part_size", "shard"), "quotas")
    inside = Window.partitionBy("name", "part").orderBy("key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)

    def span(low: Column, high: Column) -> Column:
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.col("size"))
        return F.when(low < high, F.struct(low.alias("from"), high.alias("to")))

    at = F.col("at")
    return (
        sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(placed, ["name", "part"]).withColumn("at", F.col("base") + F.col("inner"))
        .withColumn("head", span(F.lit(0) - at, F.col("c") - at))
        .withColumn("tail", span(F.col("a") - at, F.col("b") - at))
        .withColumn("taken", F.col("passes") * F.col("size")
                    + sum(F.coalesce(F.col(f"{s}.to") - F.col(f"{s}.from"), F.lit(0)) for s in ("head", "tail")))
        .select("doc", "size", "source_size", "target", "passes", "head", "tail", "taken")
    )


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mixed corpus: rows like ``docs``, a row for every pass and every range taken.

    A range is cut from the text at its words, with the white space between them.
    """
    words = F.filter(F.split("doc.text", SPACE + "+"), lambda w: w != "")
    cut = lambda s: F.array_join(F.slice(words, (F.col(f"{s}.from") + 1).cast("int"), (F.col(f"{s}.to") - F.col(f"{s}.from")).cast("int")), " ")
    mixed = mix(docs, params)
    whole = mixed.where("passes > 0").select("doc", F.col("doc.text").alias("cut"), F.explode(F.sequence(F.lit(1), F.col("passes"))))
    taken = [whole.select("doc", "cut")] + [mixed.where(f"{s} is not null").select("doc", cut(s).alias("cut")) for s in ("head", "tail")]
    rows = taken[0].union(taken[1]).union(taken[2])
    return rows.select(*(F.col("cut").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
