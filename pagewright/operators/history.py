"""The search history: append, view, delete, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.formats import milliseconds, query_label

COLUMNS = [
    "id", "query", "domain_filter", "results_count", "execution_time", "cached", "searched_at",
]


def history_rows(searches: DataFrame, searched_at: Column) -> DataFrame:
    """History rows of finished searches.

    ``searches`` has id, query, domain_filter, results_count, execution_time
    and cached.
    """
    return searches.withColumn("searched_at", searched_at).select(
        "id", "query", "domain_filter",
        F.col("results_count").cast("int").alias("results_count"),
        F.col("execution_time").cast("double").alias("execution_time"),
        F.col("cached").cast("boolean").alias("cached"),
        "searched_at",
    )


def append_history(rows: DataFrame, path: str) -> None:
    rows.select(*COLUMNS).write.mode("append").parquet(path)


def history_view(history: DataFrame, limit: int = 50) -> DataFrame:
    """The newest searches with display labels."""
    newest = history.orderBy(F.desc("searched_at"), F.desc("id")).limit(limit)
    return newest.select(
        *COLUMNS,
        query_label("query").alias("query_label"),
        milliseconds("execution_time").alias("time_label"),
    )


def delete_entries(history: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """History without the given ids; without all entries when none are given."""
    if ids is None:
        return history.limit(0)
    return history.join(ids.select("id"), "id", "left_anti")


def replay_queries(history: DataFrame) -> DataFrame:
    """Distinct past searches as a queries table.

    The smallest history id of a search serves as its query_id.
    """
    label = F.coalesce("domain_filter", F.lit("all"))
    return history.groupBy("query", label.alias("domain_filter")).agg(
        F.min("id").alias("query_id")
    ).select("query_id", "query", "domain_filter")
