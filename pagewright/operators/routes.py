"""The way from a root to each page through parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import materialize


def page_routes(pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """page_id and route (array of url, title; root first) of every page.

    A way ends at a page without parent, at a parent the table lacks, or where
    it would enter a page twice. ``wanted`` (page_id) limits the ways to the
    pages a result needs.

    Ways double: when the pages up to 2^k steps away are known, those of these
    pages that lie 2^k steps further are one join with the table of jumps over
    2^k parents, which is then joined with itself. A way of n pages takes
    log2(n) rounds. A page is kept at its first, smallest distance; a way that
    only meets pages it has is complete.
    """
    nodes = pages.select("page_id", "url", "title", F.nullif("parent_url", F.lit("")).alias("parent_url"))
    parents = nodes.select(F.col("page_id").alias("up"), F.col("url").alias("parent_url"))
    jumps = materialize(nodes.select("page_id", "parent_url").join(parents, "parent_url").select("page_id", "up"), "jumps-0")
    starts = nodes.select("page_id") if wanted is None else nodes.select("page_id").join(wanted.select("page_id"), "page_id", "left_semi")
    ways = materialize(starts.select("page_id", F.col("page_id").alias("at"), F.lit(0).cast("long").alias("steps")), "ways-0")
    met, length = ways.count(), 1
    while True:
        over = jumps.withColumnRenamed("page_id", "at")
        further = ways.join(over, "at").select("page_id", F.col("up").alias("at"), (F.col("steps") + length).alias("steps"))
        grown = materialize(
            ways.unionByName(further).groupBy("page_id", "at").agg(F.min("steps").alias("steps")), f"ways-{2 * length}")
        now = grown.count()
        if now == met:
            break
        ways, met = grown, now
        again = jumps.select(F.col("page_id").alias("up"), F.col("up").alias("_next"))
        jumps = materialize(jumps.join(again, "up").select("page_id", F.col("_next").alias("up")), f"jumps-{2 * length}")
        length *= 2
    steps = ways.join(nodes.select(F.col("page_id").alias("at"), "url", "title"), "at")
    way = F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("order"), "url", "title")))
    routes = steps.groupBy("page_id").agg(way.alias("_way"))
    return routes.select("page_id", F.transform("_way", lambda step: F.struct(step["url"].alias("url"), step["title"].alias("title"))).alias("route"))
