"""Views derived from the test tables, as Spark DataFrames.

They give the graph, cache and history operators data that grows with the
tables. ``checks.sql`` states the same views in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import extract_domain
from pagewright.operators.cache import header_rows, upsert_header
from pagewright.operators.extract import extract_text, page_outlinks
from pagewright.operators.index import Index, build_index
from pagewright.operators.ordinals import ordinal_in_group
from pagewright.params import CrawlParams, IndexParams, SearchParams
from pagewright.session import materialize, tune

# Query id, text, domain filter. One word, two words, stop word, unknown word,
# blank, accents, a domain, "all", punctuation and case.
LITERAL_QUERIES = [
    (1, "rewh", None),
    (2, "thatin ononst", None),
    (3, "the", None),
    (4, "zzzunknown", None),
    (5, "", None),
    (6, "   ", "src3"),
    (7, "für", None),
    (8, "tion", "src1"),
    (9, "orantion thatin", "all"),
    (10, "  Thatin, ONONST!  ", ""),
    (11, "tion", "nowhere"),
    (12, "", "nowhere"),
    (13, "thth in that tion", "src7"),
]
BATCH_QUERY_BASE = 1000
DERIVED_LINK_BASE = 1000
FULL_CRAWL = CrawlParams(max_pages=None, max_depth=3)
SMALL_CRAWL = CrawlParams(max_pages=100, max_depth=3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with domain, ordinal k in the domain, domain size n, crawl time."""
    pages = table(spark, sf_dir, "pages").withColumn("domain", extract_domain("url"))
    numbered = ordinal_in_group(pages, "domain", "page_id", "k")
    seconds = F.make_dt_interval(secs=F.col("page_id").cast("decimal(18,6)"))
    return numbered.withColumn("crawl_time", ntz("2024-01-01 00:00:00") + seconds)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 3-ary tree in each domain plus one extra link: f, t, pos and urls."""
    nodes = crawl_pages(spark, sf_dir).select("page_id", "url", "domain", "k", "n")
    k = F.col("k")
    targets = F.array_distinct(F.array(3 * k + 1, 3 * k + 2, 3 * k + 3, (7 * k + 3) % F.col("n")))
    wanted = nodes.select(
        F.col("page_id").alias("f"), F.col("url").alias("f_url"), "domain",
        F.explode(targets).alias("k"),
    )
    found = nodes.select(F.col("page_id").alias("t"), F.col("url").alias("t_url"), "domain", "k")
    pairs = wanted.join(found, ["domain", "k"]).where("f <> t")
    # At most four links leave a page.
    per_page = pairs.groupBy("f", "f_url").agg(F.sort_array(F.collect_list(F.struct("t", "t_url"))).alias("l"))
    flat = per_page.select("f", "f_url", F.posexplode("l").alias("p", "l"))
    return flat.select("f", "l.t", (F.col("p") + 1).alias("pos"), "f_url", "l.t_url")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each domain; ord is its page id."""
    first = crawl_pages(spark, sf_dir).where("k = 0")
    return first.select("url", F.col("page_id").alias("ord"))


def extracted(spark: SparkSession, sf_dir: str, links: bool = True) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), links=links)


def graph_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in the pages (no page has their urls) followed by derived ones."""
    own = page_outlinks(extracted(spark, sf_dir)).select("url", "pos", "link")
    derived = edges(spark, sf_dir).select(
        F.col("f_url").alias("url"),
        (F.col("pos") + DERIVED_LINK_BASE).alias("pos"),
        F.col("t_url").alias("link"),
    )
    return materialize(own.unionByName(derived), "graph-links")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page records: the search corpus."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("domain"),
    )


def doc_index(spark: SparkSession, sf_dir: str) -> Index:
    return build_index(docs(spark, sf_dir), IndexParams())


def literal_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LITERAL_QUERIES, "query_id long, query string, domain_filter string"
    )


def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per benchmark text, every third within one source."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        (item + BATCH_QUERY_BASE).alias("query_id"),
        F.col("text").alias("query"),
        F.when(item % 3 == 0, F.concat(F.lit("src"), item % 20)).alias("domain_filter"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return literal_queries(spark).unionByName(batch_queries(spark, sf_dir))


def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search per event."""
    user = F.col("user_id")
    blank = F.when(user % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("query "), user % 50))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        blank.alias("query"),
        F.when(user % 3 != 0, F.lit("example.com")).alias("domain_filter"),
        F.get_json_object("props", "$.k").cast("int").alias("results_count"),
        F.col("value").alias("execution_time"),
        (F.col("event_type") == "view").alias("cached"),
        F.col("ts").alias("searched_at"),
    )


def search_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last search of each key, living for the TTL."""
    rows = header_rows(search_history(spark, sf_dir), "searched_at", SearchParams())
    last = upsert_header(None, rows, ["created_at", "id"])
    return last.select(
        "query_hash", "query", "domain_filter", "results_count", "created_at", "expires_at"
    )


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """Half an hour after the last event, as a literal."""
    last = table(spark, sf_dir, "events").agg(
        (F.max("ts") + F.make_dt_interval(mins=F.lit(30))).cast("string").alias("t")
    )
    return ntz(last.first().t)


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl per domain; small ones still run, with a budget of 20 pages."""
    per_domain = table(spark, sf_dir, "pages").select(
        extract_domain("url").alias("crawl_id"),
        (ntz("2024-01-01 00:00:00") + F.make_dt_interval(secs=F.col("page_id").cast("decimal(18,6)"))).alias("crawl_time"),
    ).groupBy("crawl_id").agg(
        F.count("*").alias("pages_crawled"), F.min("crawl_time").alias("start_time")
    )
    pages = F.col("pages_crawled")
    return per_domain.withColumn("total_pages", F.when(pages == 1, 0).otherwise(20).cast("long")).withColumn(
        "is_crawling", (pages > 1) & (pages < 5)
    )


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
