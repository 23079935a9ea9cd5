"""Page tables: scans, upserts, snapshots, export.

A table that changes is a folder of full snapshots, ``snapshot=<n>``; readers
take the newest one that was written to its end. A reader of an older snapshot
is never disturbed, and a lost job leaves no half-written table behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import strip
from pagewright.functions.urls import extract_domain, fill_domain


def scan_pages(pages: DataFrame) -> DataFrame:
    """Successful raw fetches: page_id, url, html."""
    if "status_code" in pages.columns:
        pages = pages.where(F.col("status_code") == 200)
    return pages.select("page_id", "url", "html")


def backfill_domain(pages: DataFrame) -> DataFrame:
    """Adds ``domain`` to tables written without it; fills null and ``''``."""
    if "domain" not in pages.columns:
        pages = pages.withColumn("domain", F.lit(None).cast("string"))
    return pages.withColumn("domain", fill_domain("domain", "url"))


def upsert_pages(base: DataFrame, batch: DataFrame, seq: str, now: Column) -> DataFrame:
    """The table after a batch of crawl results, one row per url.

    The result with the highest ``seq`` wins, and of equal ones the one with the
    largest values. A stored page keeps its id and creation time; a new url has
    the batch's ``page_id``, or a hash of the url where the batch has none.
    Winners are found with a maximum, which combines on the map side. Untouched
    rows only pass an anti-join against the batch's urls, which Spark broadcasts
    when the batch is small.
    """
    fresh = [c for c in base.columns if c not in ("page_id", "url", "domain", "created_at", "updated_at")]
    given = F.col("page_id").cast("long") if "page_id" in batch.columns else F.lit(None).cast("long")
    last = batch.groupBy("url").agg(F.max(F.struct(F.col(seq).alias("_seq"), *fresh, given.alias("_id"))).alias("_new"))
    old = base.select("url", "page_id", "created_at")
    known = old.join(last.select("url"), "url", "left_semi")
    merged = last.join(known, "url", "left").select(
        F.coalesce("page_id", "_new._id", F.xxhash64("url")).alias("page_id"),
        "url",
        extract_domain("url").alias("domain"),
        F.coalesce("created_at", now).alias("created_at"),
        now.alias("updated_at"),
        *(F.col("_new").getField(c).alias(c) for c in fresh),
    )
    untouched = base.join(last.select("url"), "url", "left_anti")
    return untouched.unionByName(merged.select(base.columns))


def export_view(pages: DataFrame) -> DataFrame:
    """The exported columns, newest crawl first."""
    return pages.select(
        "url", "title", "content", "domain", "crawl_time", "depth", "parent_url"
    ).orderBy(F.desc("crawl_time"), "url")


def export_pages(pages: DataFrame, path: str) -> None:
    """Write all pages as JSON lines; part files follow the order."""
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
    export_view(pages).write.mode("overwrite").options(**options).json(path)


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots under ``path`` that were written to their end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "snapshot=*/_SUCCESS"))
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in done or [])


def write_snapshot(df: DataFrame, path: str) -> int:
    """Write ``df`` as the newest snapshot and return its number.

    One writer per table at a time; ``df`` may read the snapshot before it.
    """
    number = max(_snapshots(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/snapshot={number}")
    return number


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished snapshot."""
    numbers = _snapshots(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no finished snapshot under {path}")
    return spark.read.parquet(f"{path}/snapshot={numbers[-1]}")


def table_size(spark: SparkSession, path: str) -> DataFrame:
    """One row, ``size_bytes``: the total size of the files under ``path``.

    Only file listings are read, never contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("length").agg(F.sum("length").alias("size_bytes"))


def parse_lines(settings: DataFrame, text: str) -> DataFrame:
    """One row per non-blank line of a settings text: other columns, ord, line."""
    keep = [c for c in settings.columns if c != text]
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    return settings.select(*keep, F.posexplode(lines).alias("ord", "line"))
