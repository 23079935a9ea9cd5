"""Tables in hash buckets of a key, updated in place.

A folder holds the buckets' files, each below the version that wrote it, and a
manifest per version that says which version of each bucket counts. An update
reads and writes only the buckets that its keys fall into; the rest of the new
version are the files that were there. What no manifest in use names is removed.

    <path>/data/version=<n>/bucket=<k>/part-*.parquet
    <path>/summary/version=<n>/bucket=<k>/part-*.parquet
    <path>/manifest/version=<n>
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import materialize
from pagewright.sources.files import delete, finished, numbered

_BUCKET = "bucket"


@dataclass(frozen=True)
class BucketTable:
    """One version of a table: ``held`` says which version wrote each bucket that has rows.

    ``group`` columns in front of the key's part choose coarse buckets, so that
    keys of one group, a site, say, share few of them: a bucket is one of
    ``buckets // spread`` by group and one of ``spread`` by key. Without group
    columns buckets go by key alone.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int
    group: str | None
    spread: int
    version: int
    held: dict[int, int]

    def bucket(self) -> Column:
        """The bucket of a row."""
        by_key = F.xxhash64(F.col(self.key).cast("string"))
        if self.group is None:
            return F.pmod(by_key, F.lit(self.buckets)).cast("int")
        sites = max(1, self.buckets // self.spread)
        return (F.pmod(F.xxhash64(self.group), F.lit(sites)) * self.spread + F.pmod(by_key, F.lit(self.spread))).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that hold the keys of ``rows``, at most all there are."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table, or only the rows of some buckets: no other file is opened."""
        chosen = self.held if buckets is None else [b for b in buckets if b in self.held]
        return self._read("data", self.schema, chosen)

    def summary(self, schema: str) -> DataFrame:
        """The summaries that the updates left for the buckets they wrote."""
        return self._read("summary", T.StructType.fromDDL(schema), self.held)

    def _read(self, kind: str, schema: T.StructType, chosen: Iterable[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/version={self.held[b]}/{_BUCKET}={b}" for b in chosen]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def update(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame],
               summarise: Callable[[DataFrame], DataFrame] | None = None) -> BucketTable:
        """The next version: in the buckets of the batch's keys the rows that ``merge(stored, batch)`` returns.

        ``merge`` sees the stored rows of these buckets, and must return rows of
        the same buckets. ``summarise`` adds up the rows per ``bucket``.
        """
        batch = materialize(batch, "batch")
        buckets = self.touched(batch)
        return self.replace(buckets, merge(self.read(buckets), batch), summarise)

    def replace(self, buckets: list[int], rows: DataFrame, summarise: Callable[[DataFrame], DataFrame] | None = None) -> BucketTable:
        """The next version, with ``rows`` in place of what ``buckets`` held; one writer at a time."""
        if not buckets:
            return self
        number = max([self.version, *numbered(self.spark, f"{self.path}/data", "version=*")]) + 1
        data = f"{self.path}/data/version={number}"
        dealt = rows.select(*self.schema.names).withColumn(_BUCKET, self.bucket()).repartition(_BUCKET)
        dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(data)
        written = numbered(self.spark, data, f"{_BUCKET}=*")
        if not set(written) <= set(buckets):
            raise ValueError(f"rows of buckets {sorted(set(written) - set(buckets))} in an update of others")
        if summarise is not None:
            stored = self.spark.read.schema(self.schema).parquet(*[f"{data}/{_BUCKET}={b}" for b in written]) if written else rows.limit(0)
            summed = summarise(stored.withColumn(_BUCKET, self.bucket()))
            summed.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/summary/version={number}")
        kept = {b: v for b, v in self.held.items() if b not in set(buckets)}
        return self._commit(number, kept | dict.fromkeys(written, number))

    def clear(self) -> BucketTable:
        """The next version, without rows."""
        return self._commit(max([self.version, *numbered(self.spark, f"{self.path}/data", "version=*")]) + 1, {})

    def _commit(self, number: int, held: dict[int, int]) -> BucketTable:
        content = {"schema": self.schema.jsonValue(), "key": self.key, "buckets": self.buckets, "group": self.group,
                   "spread": self.spread, "held": sorted(held.items())}
        rows = self.spark.createDataFrame([(json.dumps(content),)], "manifest string").coalesce(1)
        rows.write.mode("overwrite").text(f"{self.path}/manifest/version={number}")
        self._remove(number, held)
        return open_buckets(self.spark, self.path)

    def _remove(self, number: int, held: dict[int, int]) -> None:
        """Remove the files that neither the new version nor the one before it, which may be read, names."""
        used = set(held.items()) | set(self.held.items())
        for kind in ("data", "summary"):
            for version in numbered(self.spark, f"{self.path}/{kind}", "version=*"):
                folder = f"{self.path}/{kind}/version={version}"
                buckets = numbered(self.spark, folder, f"{_BUCKET}=*")
                old = [b for b in buckets if (b, version) not in used]
                if len(old) == len(buckets) and version < number:
                    delete(self.spark, folder)
                else:
                    for bucket in old:
                        delete(self.spark, f"{folder}/{_BUCKET}={bucket}")
        for version in numbered(self.spark, f"{self.path}/manifest", "version=*"):
            if version not in (number, self.version):
                delete(self.spark, f"{self.path}/manifest/version={version}")


def create_buckets(spark: SparkSession, path: str, schema: str | T.StructType, key: str, buckets: int = 64,
                   group: str | None = None, spread: int = 1) -> BucketTable:
    """A new table without rows. ``buckets`` bounds what the driver lists and how finely updates write."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return BucketTable(spark, path, nullable, key, buckets, group, spread, 0, {})._commit(1, {})


def open_buckets(spark: SparkSession, path: str) -> BucketTable:
    """The newest complete version of the table at ``path``."""
    versions = finished(spark, f"{path}/manifest", "version=*")
    if not versions:
        raise FileNotFoundError(f"no table at {path}")
    content = json.loads(spark.read.text(f"{path}/manifest/version={versions[-1]}").first()[0])
    return BucketTable(spark, path, T.StructType.fromJson(content["schema"]), content["key"], content["buckets"], content["group"],
                       content["spread"], versions[-1], {b: v for b, v in content["held"]})
