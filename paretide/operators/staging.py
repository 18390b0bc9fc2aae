"""Intermediate tables written to the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: Rows of a few numbers that may be broadcast, counted before; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def staged(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """``df``, written and read again. ``replaces`` is an earlier staged table that nothing reads any more: it is deleted."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    if replaces is not None and getattr(replaces, "_staged_at", None):
        removed(spark, replaces._staged_at)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it is counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df.hint("shuffle_merge")
