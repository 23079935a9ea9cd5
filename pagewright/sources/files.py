"""Folders of tables: what is there, what is complete, what can go."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _names(spark: SparkSession, path: str, pattern: str) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) if fs.exists(root) else None
    return [s.getPath().toString() for s in found or []]


def numbered(spark: SparkSession, path: str, pattern: str) -> list[int]:
    """Numbers of the folders ``name=<n>`` that match ``pattern`` under ``path``, in order."""
    key = pattern.split("*")[0]
    return sorted(int(m[1]) for name in _names(spark, path, pattern) if (m := re.search(rf"/{re.escape(key)}(\d+)(?:/|$)", name)))


def finished(spark: SparkSession, path: str, pattern: str) -> list[int]:
    """Like ``numbered``, of folders that were written to their end."""
    return numbered(spark, path, f"{pattern}/_SUCCESS")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
