"""Keep a page table up to date from a folder that page files arrive in.

Each micro-batch is extracted and upserted the way a finished crawl is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from pagewright.operators.extract import page_records
from pagewright.plans.crawl import store_crawl

RAW_SCHEMA = (
    "page_id long, url string, html string, status_code int, depth int, parent_url string, "
    "crawl_time timestamp_ntz"
)


def ingest(spark: SparkSession, incoming: str, table: str, checkpoint: str) -> DataStreamWriter:
    """Writer of a stream of raw page files into the page table at ``table``.

    The latest crawl of a url within a batch wins. A batch that is repeated
    after a failure upserts the same rows again.
    """
    raw = spark.readStream.schema(RAW_SCHEMA).parquet(incoming)

    def store(batch: DataFrame, batch_id: int) -> None:
        records = page_records(batch, links=False).withColumn("crawl_order", F.col("crawl_time"))
        store_crawl(records, table, F.current_timestamp().cast("timestamp_ntz"))

    return raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
