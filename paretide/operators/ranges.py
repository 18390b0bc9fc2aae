"""Ordered scans of a key that is too large for one task: rows are dealt by ranges of key and order, and what passes from
a range to the next is a row for each key and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import sized, staged


def in_ranges(df: DataFrame, group: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """``df``, sorted by group and ``order`` over all tasks and written, with ``_part`` and ``_id``: a row's range, and its
    place in the order. Without a number of ``ranges`` there are as many as the rows' size asks for."""
    rows = (df.repartitionByRange(ranges, group, *order) if ranges else df.repartitionByRange(group, *order)).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id())
    return staged(rows.withColumn("_part", F.shiftright("_id", 33)), "ranges")


def _joined(rows: DataFrame, edges: DataFrame, group: str, out: list[Column]) -> DataFrame:
    same = (F.col("r._part") == F.col("e._part")) & F.col(f"r.`{group}`").eqNullSafe(F.col(f"e.`{group}`"))
    return rows.alias("r").join(sized(edges).alias("e"), same).select("r.*", *out)


def with_previous(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` of ``in_ranges`` with the ``value`` of the row before in its group as ``name``; null for the first."""
    own, parts = Window.partitionBy("_part", group).orderBy("_id"), Window.partitionBy(group).orderBy("_part")
    ends = rows.groupBy("_part", group).agg(F.max_by(value, "_id").alias("_last"), F.min("_id").alias("_first"))
    edges = ends.select("_part", group, "_first", F.lag("_last").over(parts).alias("_before"))
    lagged = rows.withColumn("_lag", F.lag(value).over(own))
    joined = _joined(lagged, edges, group, [F.when(F.col("r._id") == F.col("e._first"), F.col("e._before")).otherwise(F.col("r._lag")).alias(name)])
    return joined.drop("_lag")


def with_total(rows: DataFrame, group: str, value: Column, name: str) -> DataFrame:
    """``rows`` of ``in_ranges`` with the sum of ``value`` (long) over its group up to and with each row as ``name``."""
    own, parts = Window.partitionBy("_part", group).orderBy("_id"), Window.partitionBy(group).orderBy("_part")
    valued = rows.withColumn("_value", value.cast("long"))
    sums = valued.groupBy("_part", group).agg(F.sum("_value").alias("_sum"))
    edges = sums.select("_part", group, F.coalesce(F.sum("_sum").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    running = valued.withColumn("_run", F.sum("_value").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(running, edges, group, [(F.col("r._run") + F.col("e._before")).alias(name)]).drop("_value", "_run")
