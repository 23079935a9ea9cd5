"""The crawl job: traverse a corpus, make page records, store them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import extract_domain
from pagewright.operators.dfs import crawl_dfs
from pagewright.operators.extract import extract_text, page_outlinks, page_records
from pagewright.operators.index import add_pages, count_store, index_of_counts, store_index
from pagewright.operators.links import filter_allowed, page_links
from pagewright.operators.traverse import crawl_bfs
from pagewright.params import CrawlParams, IndexParams
from pagewright.session import bucketed, forget, materialize
from pagewright.sources.buckets import BucketTable, create_buckets, open_buckets
from pagewright.sources.tables import scan_pages, upsert_pages

PAGE_COLUMNS = [
    "page_id", "url", "title", "content", "domain", "crawl_time", "depth", "parent_url",
    "status_code", "created_at", "updated_at",
]


def corpus_links(raw_pages: DataFrame, parser: str = "auto") -> DataFrame:
    """url, pos, link of every page of a raw corpus."""
    extracted = extract_text(scan_pages(raw_pages), parser)
    return page_outlinks(extracted).select("url", "pos", "link")


def traverse(
    seeds: DataFrame, corpus: DataFrame, links: DataFrame, params: CrawlParams
) -> DataFrame:
    """Depth-first when the parameters say so, else breadth-first."""
    run = crawl_dfs if params.algorithm.lower() == "dfs" else crawl_bfs
    return run(seeds, corpus, links, params)


def crawl(
    seeds: DataFrame,
    raw_pages: DataFrame,
    params: CrawlParams,
    links: DataFrame | None = None,
    parser: str = "auto",
    allowed: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Page records of a crawl: the page columns plus crawl_order.

    Text is extracted only for the pages the crawl reaches. ``links`` defaults
    to those found in the pages. ``allowed`` (domain) is an allow list too long
    for the parameters.
    """
    raw = raw_pages if "crawl_time" in raw_pages.columns else raw_pages.withColumn(
        "crawl_time", F.current_timestamp().cast("timestamp_ntz")
    )
    found = corpus_links(raw, parser) if links is None else links
    if allowed is not None:
        seeds, found = filter_allowed(seeds, "url", allowed), filter_allowed(found, "link", allowed)
    if links is None or allowed is not None:
        found = materialize(found, "links")
    reached = materialize(traverse(seeds, scan_pages(raw), found, params), "crawl")
    # Of pages in buckets of their urls only the reached urls move to them.
    reached = reached if buckets is None else reached.repartition(buckets, "url")
    fetched = raw.select("page_id", "url", "html", "crawl_time").join(reached, "url")
    return page_records(fetched, parser, links=False)


_RAW_COLUMNS = "page_id BIGINT, url STRING, html STRING, crawl_time TIMESTAMP_NTZ"


def store_raw_pages(raw_pages: DataFrame, path: str) -> None:
    """Write raw pages (page_id, url, html, crawl_time) in buckets of their urls, for crawls that then move no HTML.

    ``path`` is a new folder. The bucket count is written last.
    """
    spark = raw_pages.sparkSession
    rows = raw_pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "crawl_time")
    _, _, name = bucketed(rows, "url", "raw-pages", f"{path}/pages")
    forget(spark, [name])
    buckets = spark.conf.get("spark.sql.shuffle.partitions")
    spark.createDataFrame([(buckets,)], "buckets string").coalesce(1).write.mode("overwrite").text(f"{path}/buckets")


def open_raw_pages(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(raw pages, number of buckets) as ``store_raw_pages`` left them, for ``crawl``."""
    buckets, name = int(spark.read.text(f"{path}/buckets").first()[0]), f"pagewright_{uuid.uuid4().hex}"
    place = f"{path}/pages".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({_RAW_COLUMNS}) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name), buckets


_PAGE_SCHEMA = (
    "page_id long, url string, title string, content string, domain string, crawl_time timestamp_ntz, depth int, "
    "parent_url string, status_code int, created_at timestamp_ntz, updated_at timestamp_ntz"
)
_LINK_SCHEMA = "from_page_id long, to_page_id long"
SUMMARY = "domain string, pages long, last_crawl timestamp_ntz"


def page_table(spark: SparkSession, path: str, buckets: int = 64, spread: int = 8) -> BucketTable:
    """The page table at ``path``, made where there is none yet.

    Buckets go by site, ``spread`` of them for each, and in a site by url. So a
    crawl of some sites touches their buckets only, and a large site is split.
    """
    try:
        return open_buckets(spark, path)
    except FileNotFoundError:
        return create_buckets(spark, path, _PAGE_SCHEMA, "url", buckets, "domain", spread)


def summarise(pages: DataFrame) -> DataFrame:
    """Page counts and last crawls by bucket and domain, which add up over buckets."""
    return pages.groupBy("bucket", "domain").agg(F.count("*").alias("pages"), F.max("crawl_time").alias("last_crawl"))


def store_crawl(results: DataFrame, table: str, now: Column, index: str | None = None, params: IndexParams = IndexParams()) -> DataFrame:
    """Upsert crawl results into the page table at ``table`` and read it back.

    Only the buckets of the results' urls are read and written. The links along
    which pages were found go to the link table beside it, see ``link_table``.
    With ``index``, a folder, the stored index there is brought up to date:
    only the results are tokenised, see ``add_pages``; ``open_index`` opens it.
    """
    spark = results.sparkSession
    stored = page_table(spark, table)
    batch = materialize(results.withColumn("domain", extract_domain("url")), "crawl-results")
    stored = stored.update(batch, lambda old, new: upsert_pages(old, new, "crawl_order", now), summarise)
    pages = stored.read()
    ids = batch.select("url", "parent_url").join(pages.select("page_id", "url"), "url")
    found = materialize(page_links(ids, pages), "found-links")
    links = link_table(spark, table)
    links.update(found, lambda old, new: old.unionByName(new.select(*old.columns)).distinct())
    if index is not None:
        changed = stored.read(stored.touched(batch)).join(batch.select("url").distinct(), "url", "left_semi")
        counts = add_pages(count_store(spark, f"{index}/counts"), changed, params)
        store_index(index_of_counts(counts, params), f"{index}/index")
    return pages


def link_table(spark: SparkSession, table: str, buckets: int = 16) -> BucketTable:
    """Discovery links (from_page_id, to_page_id) of the page table at ``table``, each once."""
    try:
        return open_buckets(spark, f"{table}/links")
    except FileNotFoundError:
        return create_buckets(spark, f"{table}/links", _LINK_SCHEMA, "to_page_id", buckets)
