"""Two-objective skyline with exact ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _front(df: DataFrame, keys: list[str], up: list[str], down: list[str]) -> DataFrame:
    """Rows (distinct in their objectives) that no row of the same key dominates."""
    (x, x_up), (y, y_up) = [(c, True) for c in up] + [(c, False) for c in down]
    order = [F.desc(x) if x_up else F.asc(x), F.desc(y) if y_up else F.asc(y)]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.max(y) if y_up else F.min(y)).over(before)
    better = F.col(y) > F.col("_best") if y_up else F.col(y) < F.col("_best")
    return df.withColumn("_best", best).filter(F.col("_best").isNull() | better).drop("_best")


def skyline(df: DataFrame, maximize: list[str], minimize: list[str], partition_by: list[str] | None = None, payload: str | None = None, salts: int = 32) -> DataFrame:
    """Non-dominated (objective, objective) pairs, with the number ``n`` of rows of each and, if asked, their payloads.

    Equal pairs are one row before any window, so ties are kept. Each key's rows are first reduced in ``salts`` parts,
    since the front of a union is the front of the parts' fronts; a key that holds most rows is then no single task.
    Rows with a null objective take no part.
    """
    keys, goals = partition_by or [], [*maximize, *minimize]
    if len(goals) != 2:
        raise ValueError("two objectives are needed")
    aggs = [F.count("*").alias("n")]
    if payload:
        aggs.append(F.sort_array(F.collect_list(payload)).alias("payloads"))
    points = df.dropna(subset=goals).groupBy(*keys, *goals).agg(F.count("*").alias("n"))
    points = points.withColumn("_salt", F.pmod(F.xxhash64(*goals), F.lit(salts)))
    front = _front(_front(points, [*keys, "_salt"], maximize, minimize).drop("_salt"), keys, maximize, minimize)
    if not payload:
        return front
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys] + [F.col(f"r.{c}") == F.col(f"f.{c}") for c in goals]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    rows = df.alias("r").join(front.drop("n").alias("f"), condition).select("r.*")
    return rows.groupBy(*keys, *goals).agg(*aggs)
