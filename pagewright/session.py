"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning: coalesces small shuffle partitions, switches to a
# broadcast once the real size of a side is known, and splits the partitions
# that one hot join key fills.
_ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_local_dirs: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Switch on the adaptive settings the jobs are written for."""
    for key, value in _ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder intermediate tables go to: ``spark.checkpoint.dir``.

    Every executor must see it. Only a local-mode session, where driver and
    executors are one process, may leave it unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pagewright-")
    return _local_dirs[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/pagewright/{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage the way a checkpoint does, in columnar form: the result
    survives lost executors, prunes columns, and has a known size, so Spark
    decides on broadcasts from facts.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str, path: str | None = None) -> tuple[DataFrame, str, str]:
    """Write ``df`` in buckets of ``key`` to the shared folder, or to ``path``: (the table, its path, its name).

    There are as many buckets as shuffle partitions, so joins and groupings by
    the key move no row of it. The name is only the session's way to know the
    buckets; ``forget`` it once they are not needed, the files stay.
    """
    spark = df.sparkSession
    path, name = path or work_path(spark, label), f"pagewright_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name), path, name


def forget(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
