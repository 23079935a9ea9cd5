"""The result cache: a header row per query key, and its best results as rows.

An entry holds the record rows shown at caching time, up to a number of rows,
and the exact number of results. So a hit shows what was found then, whatever
became of the pages. A blank query is a marker: it matches every page of its
domain, and its first pages are read when it is shown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import cache_key, strip
from pagewright.operators.index import Index
from pagewright.operators.search import blank_hits, describe_hits, keyword_hits, rank_order, top_rows, total_found
from pagewright.params import SearchParams
from pagewright.session import materialize

HEADER = (
    "query_hash string, query string, domain_filter string, blank boolean, total_found long, kept int, "
    "created_at timestamp_ntz, expires_at timestamp_ntz"
)
RECORD = (
    "query_hash string, rank int, page_id long, score double, url string, title string, domain string, "
    "content_snippet string, route array<struct<url:string,title:string>>, last_crawled timestamp_ntz"
)
Describe = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Cache:
    """header: columns of ``HEADER``; ``kept`` is how many records an entry may hold. records: columns of ``RECORD``."""

    header: DataFrame
    records: DataFrame


def empty_cache(spark: SparkSession) -> Cache:
    return Cache(spark.createDataFrame([], HEADER), spark.createDataFrame([], RECORD))


def with_key(queries: DataFrame) -> DataFrame:
    return queries.withColumn("query_hash", cache_key("query", "domain_filter"))


def header_rows(searches: DataFrame, created_at: Column | str, params: SearchParams) -> DataFrame:
    """Header rows of searches, each living for the TTL."""
    created = F.col(created_at) if isinstance(created_at, str) else created_at
    ttl = F.make_dt_interval(secs=F.lit(params.cache_ttl_seconds))
    return with_key(searches).withColumn("created_at", created).withColumn(
        "expires_at", F.col("created_at") + ttl
    )


def upsert_header(header: DataFrame | None, rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per key, the last one written.

    ``order`` columns decide what is last. A maximum combines on the map side,
    so a query asked by everyone is one row per task.
    """
    everything = rows if header is None else header.unionByName(rows)
    rest = [c for c in everything.columns if c != "query_hash"]
    last = everything.groupBy("query_hash").agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return last.select("query_hash", "_row.*")


def lookup(queries: DataFrame, header: DataFrame, as_of: Column) -> DataFrame:
    """Queries with ``cached``: whether a live entry exists."""
    live = header.where(F.col("expires_at") > as_of).select("query_hash", "expires_at")
    return with_key(queries).join(live, "query_hash", "left").withColumn(
        "cached", F.col("expires_at").isNotNull()
    )


def purge(header: DataFrame, as_of: Column) -> DataFrame:
    """The entries that have not expired."""
    return header.where(F.col("expires_at") > as_of)


def clear(header: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(empty header, one row with the number of deleted entries)."""
    return header.limit(0), header.agg(F.count("*").alias("deleted"))


def as_records(described: DataFrame) -> DataFrame:
    """Described hits with the columns of a record; route and last_crawled are null where a search gives none."""
    missing = {"route": "array<struct<url:string,title:string>>", "last_crawled": "timestamp_ntz"}
    for name, kind in missing.items():
        if name not in described.columns:
            described = described.withColumn(name, F.lit(None).cast(kind))
    return described.withColumn("rank", F.col("rank").cast("int"))


@dataclass(frozen=True)
class Answers:
    """results: query_id, the record columns, total_found, cached; totals: query_id, total_found, cached.
    new: the entries that the search adds to the cache."""

    results: DataFrame
    totals: DataFrame
    new: Cache


def search_cached(
    queries: DataFrame,
    index: Index,
    cache: Cache,
    as_of: Column,
    params: SearchParams = SearchParams(),
    describe: Describe | None = None,
) -> Answers:
    """Cache-first search.

    Equal keys are computed once. An entry answers when it is alive and holds
    as many records as are asked for, or all there were. Searches without
    results are not stored. ``describe`` adds the record columns to ranked hits
    (query_id, rank, page_id, score).
    """
    describe = describe or (lambda ranked: describe_hits(ranked, index.docs, params))
    known = purge(cache.header, as_of).select("query_hash", F.col("total_found").alias("_total"), "kept")
    answers = F.col("_total").isNotNull() & (
        (F.col("kept") >= params.limit) | (F.col("kept") >= F.col("_total")) | (strip("query") == ""))
    asked = materialize(
        with_key(queries).join(known, "query_hash", "left").select(
            *queries.columns, "query_hash", (strip("query") == "").alias("blank"),
            F.coalesce(answers, F.lit(False)).alias("cached"), "_total"),
        "asked",
    )
    misses = asked.where("not cached").groupBy("query_hash").agg(
        F.min_by(F.struct("query_id", "query", "domain_filter", "blank"), "query_id").alias("_q")
    ).select("query_hash", "_q.*")
    misses = materialize(misses, "misses")
    kept = max(params.limit, params.cache_rows)
    found = materialize(total_found(misses, index, params).where("total_found > 0"), "totals")
    entries = misses.join(found, "query_id").select(
        "query", "domain_filter", "blank", "total_found", F.lit(kept).alias("kept"))
    header = materialize(header_rows(entries, as_of, params).select(*cache.header.columns), "new-entries")
    hits = keyword_hits(misses.where("not blank"), index, params, kept)
    ranked = materialize(top_rows(hits, "query_id", rank_order(), kept, "rank"), "ranked")
    new_records = materialize(
        as_records(describe(ranked)).join(misses.select("query_id", "query_hash"), "query_id").select(*cache.records.columns),
        "new-records",
    )
    shown = [c for c in cache.records.columns if c != "query_hash"]
    old = cache.records.where(F.col("rank") <= params.limit)
    fresh = new_records.where(F.col("rank") <= params.limit)
    columns = ["query_id", "query_hash", "cached"]
    listed = (
        asked.where("cached and not blank").select(*columns).join(old, "query_hash")
        .unionByName(asked.where("not cached and not blank").select(*columns).join(fresh, "query_hash"))
        .select("query_id", *shown)
    )
    blank = top_rows(
        blank_hits(asked.where("blank").select(*queries.columns), index.docs, params.limit), "query_id",
        [F.col("page_id")], params.limit, "rank")
    listed = listed.unionByName(as_records(describe(materialize(blank, "first-pages"))).select("query_id", *shown))
    totals = asked.join(found.join(misses.select("query_id", "query_hash"), "query_id").select(
        "query_hash", F.col("total_found").alias("_new")), "query_hash", "left").select(
        "query_id", F.coalesce(F.when(F.col("cached"), F.col("_total")).otherwise(F.col("_new")), F.lit(0)).alias("total_found"), "cached")
    results = listed.join(totals, "query_id")
    return Answers(results, totals, Cache(header, new_records))


def merged(cache: Cache, new: Cache) -> Cache:
    """The cache with new entries in place of those with their keys; expired ones stay until they are purged."""
    keys = new.header.select("query_hash")
    return Cache(
        cache.header.join(keys, "query_hash", "left_anti").select(*cache.header.columns).unionByName(new.header),
        cache.records.join(keys, "query_hash", "left_anti").select(*cache.records.columns).unionByName(new.records),
    )
