"""Statistics over pages, searches, cache and crawls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.formats import iso_time, one_decimal, size_mb


def domains(pages: DataFrame) -> DataFrame:
    """Distinct domains in order."""
    return pages.where(F.col("domain").isNotNull()).select("domain").distinct().orderBy("domain")


def domain_stats(pages: DataFrame) -> DataFrame:
    """Pages per domain, most first."""
    counts = pages.groupBy("domain").agg(F.count("*").alias("pages"))
    return counts.orderBy(F.desc("pages"), "domain")


def _metric(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("metric"), value.cast("long").alias("value"))


def counts(pages: DataFrame, history: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """metric, value: pages, searches, and cache entries still alive."""
    return (
        _metric(pages, "total_pages", F.count("*"))
        .unionByName(_metric(history, "total_searches", F.count("*")))
        .unionByName(_metric(cache, "cached_queries", F.count_if(F.col("expires_at") > as_of)))
    )


def page_summary(pages: DataFrame) -> DataFrame:
    """domain, pages, last_crawl: partial statistics, which add up over parts of a table."""
    return pages.groupBy("domain").agg(F.count("*").alias("pages"), F.max("crawl_time").alias("last_crawl"))


def stats(
    pages: DataFrame,
    history: DataFrame,
    cache: DataFrame,
    vocab: DataFrame,
    as_of: Column,
    status: str | DataFrame = "idle",
    size_bytes: int | None = None,
) -> DataFrame:
    """The whole statistics record as rows: metric, key, value. See ``stats_of_summary``."""
    return stats_of_summary(page_summary(pages), history, cache, vocab, as_of, status, size_bytes)


def stats_of_summary(
    summary: DataFrame,
    history: DataFrame,
    cache: DataFrame,
    vocab: DataFrame,
    as_of: Column,
    status: str | DataFrame = "idle",
    size_bytes: int | None = None,
) -> DataFrame:
    """The statistics record from partial page statistics (domain, pages, last_crawl), several a domain or not.

    Domains and their counts are rows of metrics ``domains`` and
    ``domain_stats``, so the record stays distributed whatever their number.
    ``status`` is the state of the crawl, or a table with it, see
    ``overall_status``. A page table keeps its summary: then no page is read,
    only counts of the history and of the vocabulary and the cache's times.
    """
    def row(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), F.lit("").alias("key"), value.cast("string").alias("value"))

    fixed = summary.sparkSession.range(1)
    whole = summary.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n"), F.max("last_crawl").alias("last"))
    totals = summary.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.sum("pages").alias("pages"))
    per_domain = totals.orderBy(F.desc("pages"), "domain")
    state = fixed.select(F.lit(status).alias("status")) if isinstance(status, str) else status
    parts = [
        row(whole, "total_pages", F.col("n")),
        row(history.agg(F.count("*").alias("n")), "total_searches", F.col("n")),
        row(cache.agg(F.count_if(F.col("expires_at") > as_of).alias("n")), "cached_queries", F.col("n")),
        row(whole, "last_crawl", iso_time("last")),
        row(vocab.agg(F.count("*").alias("terms")), "index_size", F.col("terms")),
        row(state, "crawl_status", F.col("status")),
        totals.orderBy("domain").select(F.lit("domains").alias("metric"), F.col("domain").alias("key"), F.col("domain").alias("value")),
        per_domain.select(F.lit("domain_stats").alias("metric"), F.col("domain").alias("key"), F.col("pages").cast("string").alias("value")),
    ]
    if size_bytes is not None:
        parts.append(row(fixed, "database_size", size_mb(F.lit(size_bytes))))
    return reduce(DataFrame.unionByName, parts)


def overall_status(crawls: DataFrame) -> DataFrame:
    """One row, ``status``: crawling while a crawl runs, else completed once one has pages, else idle."""
    return crawls.agg(
        F.when(F.bool_or("is_crawling"), "crawling").when(F.sum("pages_crawled") > 0, "completed").otherwise("idle").alias("status"))


def crawl_status(crawls: DataFrame) -> DataFrame:
    """Progress of crawls.

    ``crawls`` has crawl_id, pages_crawled, total_pages, is_crawling. A crawl
    without budget has progress 0.
    """
    share = F.try_divide(F.col("pages_crawled") * 100.0, F.col("total_pages"))
    progress = F.when(F.col("total_pages") > 0, share).otherwise(F.lit(0.0))
    state = (
        F.when(F.col("is_crawling"), "crawling")
        .when(F.col("pages_crawled") > 0, "completed")
        .otherwise("idle")
    )
    return crawls.select(
        "crawl_id",
        state.alias("status"),
        "pages_crawled",
        "total_pages",
        progress.alias("progress_percentage"),
        F.concat(one_decimal(progress), F.lit("%")).alias("progress_label"),
    )


def crawl_eta(crawls: DataFrame, as_of: Column) -> DataFrame:
    """Estimated completion of running crawls: start + elapsed / pages * total.

    Null for crawls that are not running or have no page yet.
    """
    def micros(ts: Column) -> Column:
        return F.unix_micros(ts.cast("timestamp"))

    start = micros(F.col("start_time"))
    per_page = F.try_divide((micros(as_of) - start).cast("double"), F.col("pages_crawled"))
    total = F.round(per_page * F.col("total_pages")).cast("long")
    eta = F.timestamp_micros(start + total).cast("timestamp_ntz")
    runs = F.col("is_crawling") & (F.col("pages_crawled") > 0)
    return crawls.select(
        "crawl_id", "start_time", F.when(runs, eta).alias("estimated_completion")
    )
