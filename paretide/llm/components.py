"""Connected components of an edge table, by alternating large-star and small-star steps (no driver state).

Nodes are longs without nulls; an edge with a null end is an error of the caller and is not looked for. An edge table
without rows has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, comp): each node that has an edge, and the smallest node it reaches. ``edges``: (a, b), a <> b.

    Every round writes its edges to the shared folder, so a lost executor costs one round at most. Rounds grow with
    the logarithm of the nodes squared at most; if ``rounds`` are not enough, that is an error, not a result.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(2**40 - 1))).first())
    now = written(edges.select("a", "b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        if (seen := state(now)) == before:
            break
        before, old = seen, now
        now = written(_small_star(_large_star(now)), "edges")
        freed(old)
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
