"""Design of sequences for a table of targets, with stored back-pointers.

All jobs advance together, one letter a layer. The front that passes from layer to layer has scores only; what it came
from is written: each written layer has the points of every job and state, numbered, and for each point the numbered
points of the written layer before and the letters between (several if scores are tied). Sequences are read back from
the written layers by joins, from the last layer to the first.

A layer is a join with the machine's moves, the costs as an expression of the target, and a skyline for each job and
state. ``block`` layers make one plan and one written table. Jobs of different lengths end at the same layer: a job of n
letters enters n layers before the end. With many jobs a front is partitioned by job once a block, so its layers need no
further shuffle; few jobs are split by state as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kmer
from .cost import Place, codon_position
from .sampling import offset, universal
from .staging import folder, removed, sized, staged

#: Layers between two written ones.
BLOCK = 4
#: Joins of a walk backwards before it is written.
WALK = 8

_POINTS = "job string, v long, j int, f double, b double, froms array<struct<word: string, u: long, j: int>>"


@dataclass
class Layers:
    """Written layers of a design: their numbers, the last one's, and where they are."""

    path: str
    jobs: DataFrame
    moves: DataFrame
    numbers: list[int]
    last: int
    m: int
    start: int
    cost: Callable[[Place], Column]

    def points(self, g: int) -> DataFrame:
        return self.moves.sparkSession.read.schema(_POINTS).parquet(f"{self.path}/g={g}")

    def all_points(self) -> DataFrame:
        return self.moves.sparkSession.read.schema(f"{_POINTS}, g int").parquet(self.path)

    def removed(self) -> None:
        removed(self.moves.sparkSession, self.path)


def moves(transitions: DataFrame, scores: DataFrame) -> DataFrame:
    """(u, ctx, out): for each state its last two letters, and (sigma, v, score) of its moves."""
    out = F.struct(F.substring(F.lit(kmer.ALPHABET), F.col("sigma") + 1, F.lit(1)).alias("sigma"), F.col("v").cast("long").alias("v"), F.col("score").cast("double").alias("score"))
    pair = F.concat(*[F.substring(F.lit(kmer.ALPHABET), (F.pmod(F.expr(f"u div {d}"), F.lit(4)) + 1).cast("int"), F.lit(1)) for d in (4, 1)])
    return transitions.join(scores, "v").groupBy(F.col("u").cast("long").alias("u")).agg(F.sort_array(F.collect_list(out)).alias("out")).withColumn("ctx", pair)


def _least(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct in (f, b), that no row of the same keys dominates."""
    before = Window.partitionBy(*keys).orderBy(F.desc("f"), F.asc("b")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_least", F.min("b").over(before)).filter(F.col("_least").isNull() | (F.col("b") < F.col("_least"))).drop("_least")


def design(targets: DataFrame, transitions: DataFrame, scores: DataFrame, m: int, cost: Callable[[Place], Column], k: int = 0, alpha: float = 1.0, seed: int = 0, start: int = 0, block: int = BLOCK, max_ties: int = 0) -> Layers:
    """Write the layers of the designs of ``targets`` (job, seq, first, last).

    ``transitions`` (u, sigma, v) and ``scores`` (v, score) are a machine that keeps a state's last two letters; a state's
    score counts from layer m on. f is minus the sum of costs, b the sum of scores. ``k`` bounds the points of a job and
    state by universal sampling, ``max_ties`` those that one point is remembered to come from (the first letters in order;
    0: all). What an infinite cost leads to is dropped at once. Empty targets have no layers.
    """
    spark = targets.sparkSession
    jobs = staged(targets.select(F.col("job").cast("string").alias("job"), "seq", "first", "last", F.length("seq").alias("n")).filter("n > 0"), "targets")
    whole = jobs.agg(F.max("n").alias("n"), F.count("*").alias("jobs")).first()
    last = whole["n"] or 0
    steps = staged(moves(transitions, scores), "moves")
    known = sized(steps)
    many = whole["jobs"] >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = Layers(folder(spark, "layers"), jobs, steps, [], last, m, start, cost)
    front = spark.createDataFrame([], _POINTS)
    layer = _layer(known, m, cost, max_ties)
    for g0 in range(1, last + 1, block):
        g1 = min(g0 + block - 1, last)
        enter = jobs.filter((last - F.col("n")).between(g0 - 1, g1 - 1)).select("job", F.lit(start).cast("long").alias("v"), F.lit(0).alias("j"), F.lit(0.0).alias("f"), F.lit(0.0).alias("b"))
        rows = front.select("job", "v", "j", "f", "b").union(enter)
        rows = rows.select("job", F.col("v").alias("u"), "f", "b", F.array(F.struct(F.lit("").alias("word"), F.col("v").alias("u"), "j")).alias("froms"))
        # the letters around the block's positions; ``at`` is the position of its first layer, below 1 for jobs that enter later
        near = jobs.filter(last - F.col("n") < g1).select("job", "first", "last", "n", (g0 - last + F.col("n")).alias("at"), F.substring(F.concat(F.lit("A" * (block + 2)), "seq"), g0 - last + F.col("n") + block, F.lit(block + 2)).alias("near"))
        if many:
            rows, near = rows.repartition("job"), near.repartition("job")
        rows = rows.join(near, "job")
        for t in range(g1 - g0 + 1):
            rows = layer(rows)
            if k:
                rows = universal(rows, ["job", "u"], "f", [F.desc("f"), F.asc("b")], k, alpha, F.greatest(F.col("at") - 1, F.lit(1)), offset(seed + g0 + t, "job", "u"))
        place = F.row_number().over(Window.partitionBy("job", "u").orderBy(F.desc("f"), F.asc("b"))) - 1
        rows.select("job", F.col("u").alias("v"), place.cast("int").alias("j"), "f", "b", "froms").write.parquet(f"{out.path}/g={g1}")
        out.numbers.append(g1)
        front = out.points(g1)
    return out


def _layer(known: DataFrame, m: int, cost: Callable[[Place], Column], max_ties: int) -> Callable[[DataFrame], DataFrame]:
    """One letter more for the jobs that have entered; the others stay as they are. The expressions, built once, are those
    of any layer: ``at`` is a job's position in it, the third letter of ``near`` the target's there."""
    carried, at = ["job", "first", "last", "n", "at", "near"], F.col("at")
    stay = F.array(F.struct(F.lit("").alias("sigma"), F.col("u").alias("v"), F.lit(0.0).alias("score")))
    moved = [*carried, "f", "b", "froms", "ctx", F.explode(F.when(at >= 1, F.col("out")).otherwise(stay)).alias("_o")]
    here = Place(F.substring("near", 3, 1), codon_position(at, F.col("first"), F.col("last")), F.substring("near", 1, 3), F.col("ctx"), F.col("_o.sigma"))
    f = F.col("f") - F.when(at >= 1, cost(here)).otherwise(0.0)
    b = F.col("b") + F.when(at >= m, F.col("_o.score")).otherwise(0.0)
    froms = F.transform("froms", lambda x: F.struct(F.concat(x["word"], F.col("_o.sigma")).alias("word"), x["u"].alias("u"), x["j"].alias("j")))
    onward = ["job", "first", "last", "n", (at + 1).alias("at"), F.expr("substring(near, 2)").alias("near"), F.col("_o.v").alias("u"), f.alias("f"), b.alias("b"), froms.alias("froms")]
    ties = F.array_sort(F.flatten(F.collect_list("froms")))
    merged = (F.slice(ties, 1, max_ties) if max_ties else ties).alias("froms")
    possible = F.col("f") > float("-inf")
    return lambda rows: _least(rows.join(known, "u").select(*moved).select(*onward).filter(possible).groupBy(*carried, "u", "f", "b").agg(merged), ["job", "u"])


def front(layers: Layers, k: int = 0, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(job, f, b, v, j): the end points of every job's front over all states."""
    if not layers.numbers:
        return layers.jobs.sparkSession.createDataFrame([], "job string, f double, b double, v long, j int")
    points = layers.points(layers.last).drop("froms")
    best = _least(points.select("job", "f", "b").distinct(), ["job"])
    if k:
        best = universal(best.join(layers.jobs.select("job", "n"), "job"), ["job"], "f", [F.desc("f"), F.asc("b")], k, alpha, F.col("n"), offset(seed, "job")).drop("n")
    return points.join(best, ["job", "f", "b"])


def sequences(layers: Layers, ends: DataFrame, max_ties: int = 0) -> DataFrame:
    """(job, f, b, seq) of the end points ``ends`` (job, f, b, v, j): a join with each written layer, last one first.

    ``max_ties`` bounds the ways on that are followed for one (job, f, b) at each written layer: those with the first
    letters in order (0: all).
    """
    walk = ends.select("job", "f", "b", "v", "j", F.lit("").alias("seq"))
    own = Window.partitionBy("job", "f", "b").orderBy("seq", "v", "j")
    for step, g in enumerate(reversed(layers.numbers), 1):
        # a job that entered after this layer has no points here, and its walk is at its start
        here = layers.points(g).select("job", "v", "j", "froms").withColumn("_here", F.lit(True))
        each = walk.join(here, ["job", "v", "j"], "left").withColumn("_p", F.explode_outer("froms"))
        walk = each.select("job", "f", "b", F.coalesce("_p.u", "v").alias("v"), F.coalesce("_p.j", "j").alias("j"), F.concat(F.coalesce("_p.word", F.lit("")), "seq").alias("seq")).distinct()
        if max_ties:
            walk = walk.withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= max_ties).drop("_r")
        if step % WALK == 0:
            walk = staged(walk, "walk", walk)
    return walk.select("job", "f", "b", "seq").distinct()


def sizes(layers: Layers) -> DataFrame:
    """(job, i, v, size, pruned) of every state and position, 0 for states that nothing reaches; from layers with a block of 1.

    ``pruned`` counts the points before it that an infinite cost stopped, from position m on.
    """
    lengths = layers.jobs.select("job", "n")
    i = F.col("g") - F.lit(layers.last) + F.col("n")
    kept = layers.all_points().groupBy("job", "g", "v").agg(F.count("*").alias("size")).join(lengths, "job").select("job", i.alias("i"), "v", "size")
    enter = lengths.select("job", F.lit(0).alias("i"), F.lit(layers.start).cast("long").alias("v"), F.lit(1).cast("long").alias("size"))
    before = kept.union(enter).select("job", (F.col("i") + 1).alias("i"), F.col("v").alias("u"), "size").join(sized(layers.moves), "u")
    before = before.join(layers.jobs, "job").filter(F.col("i") <= F.col("n")).filter(F.col("i") >= layers.m)
    near = F.substring(F.concat(F.lit("AA"), "seq"), F.col("i"), F.lit(3))
    before = before.withColumn("_o", F.explode("out")).withColumn("_near", near)
    here = Place(F.substring("_near", 3, 1), codon_position(F.col("i"), F.col("first"), F.col("last")), F.col("_near"), F.col("ctx"), F.col("_o.sigma"))
    stopped = before.filter(layers.cost(here) == float("inf")).groupBy("job", "i", F.col("_o.v").alias("v")).agg(F.sum("size").alias("pruned"))
    states = layers.moves.agg(F.collect_list("u").alias("_states"))  # one row: the machine's states
    cells = lengths.select("job", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).crossJoin(F.broadcast(states)).select("job", "i", F.explode("_states").alias("v"))
    out = cells.join(kept, ["job", "i", "v"], "left").join(stopped, ["job", "i", "v"], "left")
    return out.select("job", F.col("i").cast("int").alias("i"), "v", F.coalesce("size", F.lit(0)).cast("int").alias("size"), F.coalesce("pruned", F.lit(0)).cast("int").alias("pruned"))
