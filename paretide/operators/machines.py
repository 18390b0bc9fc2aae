"""Reduction of the De Bruijn machine: by colours (coarsest refinement) and without (greedy merging by score)."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kmer, motif
from .staging import staged


def motif_machine(counts: DataFrame, matrix_id: str, strands: tuple[str, ...] = ("forward",)) -> tuple[int, DataFrame, DataFrame]:
    """A motif's length, the De Bruijn machine of that length and its states' scores (v, kmer, one column a strand)."""
    w = motif.weights(motif.pssm(counts), matrix_id)
    spark, m = counts.sparkSession, len(w)
    states = kmer.lattice(spark, m)
    return m, kmer.transitions(spark, m), states.select("v", "kmer", *[motif.score(F.col("kmer"), w, s).alias(s) for s in strands])


def from_coloring(states: DataFrame, bins: DataFrame, color: str = "color") -> DataFrame:
    """(v, color) of (v, kmer) by bins (color, patterns); states in no bin have no colour (null)."""
    each = bins.select(F.col(color).alias("color"), F.explode("patterns").alias("kmer"))
    return states.select("v", "kmer").join(each, "kmer", "left").select("v", "color")


def recolor(states: DataFrame, coloring: DataFrame) -> DataFrame:
    """``states`` (v, color, ...) with the colours of another colouring (v, color); null where it has none."""
    return states.drop("color").join(coloring.select("v", "color"), "v", "left")


def reduced_machine(transitions: DataFrame, classes: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transitions between representatives, and their mean scores (v, score)."""
    approx = approximate_scores(classes, scores).select(F.col("rep").alias("v"), F.col("approx").alias("score")).distinct()
    return reduced_transitions(transitions, classes), approx


def colored_classes(states: DataFrame, m: int, suffix: int = 2) -> DataFrame:
    """(v, rep): the smallest state of each state's class in the irreducible coloured machine.

    ``states`` has (v, color) for all k-mers of length m, by code. Classes start as (colour, last ``suffix`` letters) and
    are refined by the classes of the four successors, until their number stands still: at most m rounds, as any two
    k-mers meet after m letters. The successors of a state are the four k-mers that begin with its last m - 1 letters, so
    one row for each such beginning holds the four classes, and a round is one join with it. Each round is written; the
    plan of a round is always the same.
    """
    tails = F.lit(4 ** (m - 1))
    key = F.concat(F.coalesce(F.concat(F.lit("c"), F.col("color").cast("string")), F.lit("none")), F.lit("/"), F.pmod("v", F.lit(4**suffix)).cast("string"))
    keyed = states.select(F.col("v").cast("long").alias("v"), key.alias("_key"))
    now = staged(keyed.join(keyed.groupBy("_key").agg(F.min("v").alias("rep")), "_key").select("v", "rep"), "classes")
    known = now.select("rep").distinct().count()
    for _ in range(m):
        after = [f"r{s}" for s in range(4)]
        moves = now.groupBy(F.expr("v div 4").alias("_tail")).agg(*[F.max(F.when(F.pmod("v", F.lit(4)) == s, F.col("rep"))).alias(r) for s, r in enumerate(after)])
        each = now.withColumn("_tail", F.pmod("v", tails)).join(moves, "_tail")
        finer = each.groupBy("rep", *after).agg(F.min("v").alias("_finer"))
        now = staged(each.join(finer, ["rep", *after]).select("v", F.col("_finer").alias("rep")), "classes", now)
        before, known = known, now.select("rep").distinct().count()
        if known == before:
            break
    return now


def reduced_transitions(transitions: DataFrame, classes: DataFrame) -> DataFrame:
    """Transitions between representatives: (u, sigma, v), distinct."""
    a = classes.select(F.col("v").alias("u"), F.col("rep").alias("ru"))
    b = classes.select("v", F.col("rep").alias("rv"))
    return transitions.join(a, "u").join(b, "v").select(F.col("ru").alias("u"), "sigma", F.col("rv").alias("v")).distinct()


def violations(transitions: DataFrame, classes: DataFrame, states: DataFrame, suffix: int = 2) -> DataFrame:
    """Classes that break the machine: two colours, two successors for a letter, or two classes that could still merge. Empty if valid."""
    colors = classes.join(states, "v").groupBy("rep").agg(F.countDistinct("color").alias("n"), F.min("color").alias("color")).select("rep", "n", "color")
    moves = reduced_transitions(transitions, classes)
    two = moves.groupBy("u", "sigma").count().filter("count > 1").select(F.col("u").alias("rep"), F.lit("successor").alias("fault"))
    out = moves.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sigma", "v"))).alias("out")).withColumn("tail", F.pmod("u", F.lit(4**suffix)))
    alike = out.join(colors.select(F.col("rep").alias("u"), "color"), "u").groupBy("out", "tail", "color").agg(F.count("*").alias("n"), F.min("u").alias("rep")).filter("n > 1")
    return colors.filter("n > 1").select("rep", F.lit("color").alias("fault")).union(two).union(alike.select("rep", F.lit("mergeable").alias("fault")))


def approximate_scores(classes: DataFrame, scores: DataFrame) -> DataFrame:
    """(v, rep, score, approx): each state's score and the mean of its class."""
    return classes.join(scores, "v").withColumn("approx", F.avg("score").over(Window.partitionBy("rep"))).select("v", "rep", "score", "approx")


def reduction_mse(approx: DataFrame) -> DataFrame:
    return approx.agg(F.bround(F.avg(F.pow(F.col("score") - F.col("approx"), 2)), 6).alias("mse"), F.countDistinct("rep").alias("n_states"))


def ward_distances(states: DataFrame, m: int) -> DataFrame:
    """(a, b, d): the Ward distance of each pair of states that share their last m - 1 letters, four to a group."""
    x = states.select(F.pmod("v", F.lit(4 ** (m - 1))).alias("tail"), F.col("v").alias("a"), F.col("score").alias("sa"))
    y = states.select(F.pmod("v", F.lit(4 ** (m - 1))).alias("tail"), F.col("v").alias("b"), F.col("score").alias("sb"))
    return x.join(y, "tail").filter("a < b").select("a", "b", (F.pow(F.col("sa") - F.col("sb"), 2) / 2).alias("d"))


def greedy_merges(score: list[float], m: int, suffix: int = 2) -> list[tuple[int, int, int, float, int, float]]:
    """(step, kept, removed, distance, states left, mse) of merging the closest pair of equivalent states until none is left.

    States are equivalent if their successors and last ``suffix`` letters are equal. Ties go to the smaller pair.
    """
    n = 4**m
    out = {v: tuple((v * 4 + s) % n for s in range(4)) for v in range(n)}
    into: dict[int, set[int]] = {v: set() for v in range(n)}
    for u, targets in out.items():
        for v in targets:
            into[v].add(u)
    size, mean = [1] * n, list(score)
    group: dict[tuple, set[int]] = {}
    for v in range(n):
        group.setdefault((out[v], v % 4**suffix), set()).add(v)
    heap: list[tuple[float, int, int, int, int]] = []
    version = [0] * n
    alive = [True] * n

    def push(a: int, b: int) -> None:
        a, b = min(a, b), max(a, b)
        d = size[a] * size[b] * (mean[a] - mean[b]) ** 2 / (size[a] + size[b])
        heapq.heappush(heap, (d, a, b, version[a], version[b]))

    for members in group.values():
        ordered = sorted(members)
        for i, a in enumerate(ordered):
            for b in ordered[i + 1 :]:
                push(a, b)
    trace, sse, left = [], 0.0, n
    while heap:
        d, a, b, va, vb = heapq.heappop(heap)
        if not (alive[a] and alive[b] and version[a] == va and version[b] == vb):
            continue
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        version[a] += 1
        own = group[(out[a], a % 4**suffix)]
        own.discard(b)
        for c in own:
            if c != a:
                push(a, c)
        for v in set(out[b]):
            into[v].discard(b)
        for u in sorted(into.pop(b, ())):
            if not alive[u]:
                continue
            old = (out[u], u % 4**suffix)
            group[old].discard(u)
            out[u] = tuple(a if v == b else v for v in out[u])
            into[a].add(u)
            key = (out[u], u % 4**suffix)
            for c in group.setdefault(key, set()):
                push(u, c)
            group[key].add(u)
        sse, left = sse + d, left - 1
        trace.append((len(trace) + 1, a, b, d, left, sse / n))
    return trace


def reduction_traces(scores: DataFrame, m: int, suffix: int = 2) -> DataFrame:
    """(fsm_id, step, kept, removed, distance, n_states, mse) for each machine of (fsm_id, v, score); one task a machine."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = greedy_merges(pdf.sort_values("v")["score"].tolist(), m, suffix)
        out = pd.DataFrame(rows, columns=["step", "kept", "removed", "distance", "n_states", "mse"])
        out.insert(0, "fsm_id", pdf["fsm_id"].iloc[0])
        return out

    return scores.groupBy("fsm_id").applyInPandas(run, "fsm_id string, step int, kept long, removed long, distance double, n_states int, mse double")


def state_map_at(traces: DataFrame, m: int, n_states: int) -> DataFrame:
    """(fsm_id, v, rep): the classes when ``n_states`` are left."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = list(range(4**m))
        for a, b in pdf[pdf["n_states"] >= n_states].sort_values("step")[["kept", "removed"]].itertuples(index=False):
            rep[b] = a
        def find(v: int) -> int:
            while rep[v] != v:
                v = rep[v]
            return v
        return pd.DataFrame({"fsm_id": pdf["fsm_id"].iloc[0], "v": range(4**m), "rep": [find(v) for v in range(4**m)]})

    return traces.groupBy("fsm_id").applyInPandas(run, "fsm_id string, v long, rep long")


def trace_invariants(traces: DataFrame, scores: DataFrame, m: int) -> DataFrame:
    """(fsm_id, n_steps, n_states, mse, sums_agree, n_faults): what must hold of each trace of ``reduction_traces``.

    ``sums_agree``: the distances add up to the squared error of the last classes, as computed from ``scores`` again.
    ``n_faults``: steps that don't leave one state less than the step before, classes of the last step whose states move
    to two classes by one letter, and last errors that aren't the distances' sum over the states.
    """
    last = traces.groupBy("fsm_id").agg(F.count("*").alias("n_steps"), F.min("n_states").alias("n_states"), F.max("mse").alias("mse"), F.sum("distance").alias("_d"))
    gaps = traces.filter(F.col("n_states") != 4**m - F.col("step")).groupBy("fsm_id").agg(F.count("*").alias("_g"))
    classes = state_map_at(traces, m, 0)
    sse = classes.join(scores, ["fsm_id", "v"]).groupBy("fsm_id", "rep").agg((F.var_pop("score") * F.count("*")).alias("_e")).groupBy("fsm_id").agg(F.sum("_e").alias("_sse"))
    moves = classes.withColumn("sigma", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("_t", F.pmod(F.col("v") * 4 + F.col("sigma"), F.lit(4**m)))
    after = classes.select("fsm_id", F.col("v").alias("_t"), F.col("rep").alias("_after"))
    split = moves.join(after, ["fsm_id", "_t"]).groupBy("fsm_id", "rep", "sigma").agg(F.countDistinct("_after").alias("n")).filter("n > 1").groupBy("fsm_id").agg(F.count("*").alias("_s"))
    near = lambda a, b: F.abs(a - b) <= 1e-9 * (1 + F.abs(a) + F.abs(b))
    out = last.join(sse, "fsm_id").join(gaps, "fsm_id", "left").join(split, "fsm_id", "left")
    wrong = (~near(F.col("mse"), F.col("_d") / 4**m)).cast("long")
    return out.select("fsm_id", "n_steps", "n_states", "mse", near(F.col("_d"), F.col("_sse")).alias("sums_agree"), (F.coalesce("_g", F.lit(0)) + F.coalesce("_s", F.lit(0)) + wrong).alias("n_faults"))


def _reduced(n: int, last: int) -> float:
    """Share of the ``last`` states that is gone; of none, what a division of doubles gives (without end if n is below 0)."""
    return 1 - n / last if last else -math.copysign(math.inf, n)


def pick_reductions(traces: DataFrame, origin_size: int, least_delta: float, least_ratio: float) -> DataFrame:
    """The steps just before both the error and the reduction, against the last picked step, pass their thresholds. A
    picked step may have 0 states."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(0, origin_size, 0.0), *pdf.sort_values("step")[["step", "n_states", "mse"]].itertuples(index=False)]
        last, out = (origin_size, 0.0), []
        for before, (_, n, mse) in zip(rows[1:], rows[2:], strict=False):
            if mse - last[1] >= least_delta and _reduced(n, last[0]) >= least_ratio:
                out.append(tuple(before))
                last = (before[1], before[2])
        got = pd.DataFrame(out, columns=["step", "n_states", "mse"])
        got.insert(0, "fsm_id", pdf["fsm_id"].iloc[0])
        return got

    return traces.groupBy("fsm_id").applyInPandas(run, "fsm_id string, step int, n_states int, mse double")
