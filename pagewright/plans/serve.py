"""The search job: answer a batch of queries against stored tables.

Folders under one root hold the state between runs: ``cache`` and
``cache_records``, in hash buckets of the query key, and ``history``, an
append-only table.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.cache import HEADER, RECORD, Cache, search_cached
from pagewright.operators.history import COLUMNS, append_history, delete_entries, history_rows
from pagewright.operators.index import Index
from pagewright.operators.routes import page_routes
from pagewright.operators.search import describe_hits, ranked_hits, total_found, with_route_and_time
from pagewright.params import SearchParams
from pagewright.session import materialize
from pagewright.sources.buckets import BucketTable, create_buckets, open_buckets
from pagewright.sources.tables import read_snapshot, write_snapshot

_BUCKETS = 32


def cache_tables(spark: SparkSession, root: str) -> tuple[BucketTable, BucketTable]:
    """(header, records) of the cache under ``root``, made where there is none yet."""
    out = []
    for name, schema in (("cache", HEADER), ("cache_records", RECORD)):
        try:
            out.append(open_buckets(spark, f"{root}/{name}"))
        except FileNotFoundError:
            out.append(create_buckets(spark, f"{root}/{name}", schema, "query_hash", _BUCKETS))
    return out[0], out[1]


def load_cache(spark: SparkSession, root: str, queries: DataFrame | None = None) -> Cache:
    """The stored cache; with ``queries`` (query_hash) only the buckets that may answer them."""
    header, records = cache_tables(spark, root)
    buckets = None if queries is None else header.touched(queries)
    return Cache(header.read(buckets), records.read(buckets))


def _replaced(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return stored.join(batch.select("query_hash").distinct(), "query_hash", "left_anti").select(*batch.columns).unionByName(batch)


def store_cache(spark: SparkSession, new: Cache, root: str) -> None:
    """Put new entries in place of those with their keys.

    Records first: a header never names records that are not there. Only the
    buckets of the new keys are read and written.
    """
    header, records = cache_tables(spark, root)
    keys = materialize(new.header, "keys")
    old = records.read(records.touched(keys)).join(keys.select("query_hash"), "query_hash", "left_anti")
    records.replace(records.touched(keys), old.select(*new.records.columns).unionByName(new.records))
    header.update(keys, _replaced)


def purge_cache(spark: SparkSession, root: str, as_of: Column) -> int:
    """Remove expired entries and return how many; buckets without one stay as they are."""
    header, records = cache_tables(spark, root)
    dead = materialize(header.read().where(~(F.col("expires_at") > as_of)).select("query_hash"), "expired")
    buckets = header.touched(dead)
    for table in (header, records):
        table.replace(buckets, table.read(buckets).join(dead, "query_hash", "left_anti"))
    return dead.count()


def clear_cache(spark: SparkSession, root: str) -> int:
    """Delete all entries and return how many there were."""
    header, records = cache_tables(spark, root)
    deleted = header.read().count()
    header.clear()
    records.clear()
    return deleted


def load_history(spark: SparkSession, root: str) -> DataFrame:
    """The search history without deleted entries."""
    rows = spark.read.parquet(f"{root}/history")
    try:
        return delete_entries(rows, read_snapshot(spark, f"{root}/history_deleted"))
    except FileNotFoundError:
        return rows


def delete_history(spark: SparkSession, root: str, ids: DataFrame | None = None) -> None:
    """Delete the history entries ``ids(id)``, or all: their ids are noted, and readers leave them out."""
    gone = (load_history(spark, root) if ids is None else ids).select("id")
    try:
        gone = gone.unionByName(read_snapshot(spark, f"{root}/history_deleted"))
    except FileNotFoundError:
        pass
    write_snapshot(gone.distinct(), f"{root}/history_deleted")


def serve(
    queries: DataFrame,
    index: Index,
    root: str,
    as_of: Column,
    params: SearchParams = SearchParams(),
    use_cache: bool = True,
    pages: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of a batch; updates cache and history under ``root``.

    Results carry url, title, domain and snippet, and with ``pages`` (page_id,
    url, title, parent_url, crawl_time) the route to a page and its last crawl.
    The summary has one row per query: total_found, cached, execution_time_ms,
    the batch time shared by its queries. Expired entries leave the cache first.
    """
    spark = queries.sparkSession
    start = time.monotonic()

    def describe(ranked: DataFrame) -> DataFrame:
        shown = describe_hits(ranked, index.docs, params)
        return shown if pages is None else with_route_and_time(shown, ranked, pages, lambda wanted: page_routes(pages, wanted))

    if use_cache:
        purge_cache(spark, root, as_of)
        found = search_cached(queries, index, load_cache(spark, root), as_of, params, describe)
        results = materialize(found.results.drop("total_found", "cached"), "results")
        totals = found.totals
        store_cache(spark, found.new, root)
    else:
        results = materialize(describe(materialize(ranked_hits(queries, index, params), "ranked")), "results")
        totals = total_found(queries, index, params).withColumn("cached", F.lit(False))
    counts = materialize(queries.join(totals, "query_id"), "summary")
    summary = counts.withColumn("execution_time_ms", F.lit((time.monotonic() - start) * 1000))
    searches = summary.select(
        F.xxhash64("query_id", as_of).alias("id"), "query", "domain_filter",
        F.col("total_found").alias("results_count"),
        F.col("execution_time_ms").alias("execution_time"), "cached",
    )
    append_history(history_rows(searches, as_of).select(*COLUMNS), f"{root}/history")
    return results, summary
