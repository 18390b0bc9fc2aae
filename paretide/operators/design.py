"""Design of sequences on the front of (functional score up, binding score down), by a layered dynamic program.

A layer holds, for each job and machine state, the front of the prefixes that end there. Two forms with one result:
``design_frames`` runs each layer as a relational step over all jobs (joins with the small cost and score tables,
then a skyline a state), for short sequences or wide jobs; ``design_kernel`` runs each job in one task, jobs in
parallel, for long sequences. f is minus the sum of costs, b the sum of the scores of the states from layer m on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import shared_folder
from .sampling import offset, universal

#: Layers between two checkpoints of ``design_frames``.
CHECKPOINT_EVERY = 4


def design_frames(jobs: DataFrame, transitions: DataFrame, scores: DataFrame, costs: DataFrame, m: int, n: int, k: int = 0, alpha: float = 1.0, seed: int = 0, start: int = 0) -> DataFrame:
    """(job, f, b, seq) of the non-dominated sequences of length n, all ties.

    ``jobs`` (job), ``transitions`` (u, sigma, v), ``scores`` (v, score), ``costs`` (job, i, ctx, sigma, cost). Infinite
    costs are filtered before any sum. ``k`` bounds each state's front by universal sampling.
    """
    steps = transitions.join(scores, "v").select("u", "v", F.substring(F.lit("ACGT"), F.col("sigma") + 1, F.lit(1)).alias("sigma"), "score")
    front = jobs.select("job", F.lit(start).cast("long").alias("u"), F.lit(0.0).alias("f"), F.lit(0.0).alias("b"), F.array(F.lit("")).alias("seqs"))
    for i in range(1, n + 1):
        cost = costs.filter((F.col("i") == i) & (F.col("cost") < float("inf"))).select("job", "ctx", "sigma", "cost")
        each = front.join(steps, "u").withColumn("ctx", F.translate(F.lpad(F.conv((F.pmod(F.col("u"), F.lit(16))).cast("string"), 10, 4), 2, "0"), "0123", "ACGT"))
        each = each.join(cost, ["job", "ctx", "sigma"])
        gain = F.col("score") if i >= m else F.lit(0.0)
        points = each.select("job", "v", (F.col("f") - F.col("cost")).alias("f"), (F.col("b") + gain).alias("b"), F.transform("seqs", lambda s: F.concat(s, F.col("sigma"))).alias("seqs"))
        points = points.groupBy("job", "v", "f", "b").agg(F.flatten(F.collect_list("seqs")).alias("seqs"))
        state = Window.partitionBy("job", "v")
        order = [F.desc("f"), F.asc("b")]
        least = F.min("b").over(state.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        front = points.withColumn("_least", least).filter(F.col("_least").isNull() | (F.col("b") < F.col("_least"))).drop("_least")
        front = universal(front, ["job", "v"], "f", order, k, alpha, i, offset(seed + i, "job", "v"))
        front = front.withColumnRenamed("v", "u")
        if i % CHECKPOINT_EVERY == 0 and i < n:
            front = _cut(front)
    whole = Window.partitionBy("job").orderBy(F.desc("f"), F.asc("b")).rowsBetween(Window.unboundedPreceding, -1)
    points = front.groupBy("job", "f", "b").agg(F.flatten(F.collect_list("seqs")).alias("seqs"))
    points = points.withColumn("_least", F.min("b").over(whole)).filter(F.col("_least").isNull() | (F.col("b") < F.col("_least")))
    points = universal(points.drop("_least"), ["job"], "f", [F.desc("f"), F.asc("b")], k, alpha, n, offset(seed, "job"))
    return points.select("job", "f", "b", F.explode("seqs").alias("seq")).distinct()


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage at the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _front(f: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the candidates, index of its front's group for each kept one): ties share a group."""
    order = np.lexsort((b, -f))
    fs, bs = f[order], b[order]
    least = np.minimum.accumulate(bs)
    first = np.ones(len(fs), dtype=bool)
    first[1:] = (fs[1:] != fs[:-1]) | (bs[1:] != bs[:-1])
    good = np.ones(len(fs), dtype=bool)
    good[1:] = bs[1:] < least[:-1]
    group = np.cumsum(first) - 1
    keep = good[first][group]
    return order[keep], group[keep]


def _sampled(f: np.ndarray, k: int, alpha: float, position: int, u0: float) -> np.ndarray:
    """Universal sampling as in ``sampling.universal``: rows whose running weight passes a pointer, at most ``k``."""
    if k == 0 or len(f) <= k:
        return np.arange(len(f))
    run = np.cumsum((1 - f / position) ** -alpha)
    passed = np.floor(run * (k / run[-1]) - u0)
    return np.flatnonzero(np.diff(passed, prepend=-1.0) > 0)


def design_job(edges: np.ndarray, score: np.ndarray, cost: np.ndarray, m: int, n: int, k: int, alpha: float, seed: int, start: int, max_ties: int) -> tuple[list[tuple[float, float, str]], list[tuple[int, int, int, int]]]:
    """One job: ``edges`` rows (u, sigma, v), ``cost[i, ctx, sigma]``. Returns the solutions and (layer, state, size, pruned)
    rows: the points kept, and the points of predecessors that an infinite cost stopped, counted from layer m on."""
    rng = np.random.default_rng(seed)
    layer = {start: (np.zeros(1), np.zeros(1))}
    back: list[dict[int, list[list[tuple[int, int, int]]]]] = []
    sizes = []
    into: dict[int, list[tuple[int, int]]] = {}
    for u, s, v in edges.tolist():
        into.setdefault(v, []).append((u, s))
    for i in range(1, n + 1):
        new, links = {}, {}
        for v, sources in into.items():
            reached = [(u, s, layer[u]) for u, s in sources if u in layer]
            parts = [x for x in reached if np.isfinite(cost[i - 1, x[0] % 16, x[1]])]
            pruned = sum(len(x[2][0]) for x in reached) - sum(len(x[2][0]) for x in parts) if i >= m else 0
            if not parts:
                sizes.append((i, v, 0, pruned))
                continue
            f = np.concatenate([x[0] - cost[i - 1, u % 16, s] for u, s, x in parts])
            b = np.concatenate([x[1] + (score[v] if i >= m else 0.0) for u, s, x in parts])
            origin = [(u, s, j) for u, s, x in parts for j in range(len(x[0]))]
            kept, group = _front(f, b)
            heads = np.unique(group, return_index=True)[1]
            pick = _sampled(f[kept[heads]], k, alpha, i, rng.random())
            chosen = np.unique(group)[pick]
            new[v] = (f[kept[heads]][pick], b[kept[heads]][pick])
            links[v] = [[origin[c] for c in kept[group == g].tolist()] for g in chosen]
            sizes.append((i, v, len(pick), pruned))
        layer = new
        back.append(links)
    ends = [(v, j) for v in layer for j in range(len(layer[v][0]))]
    if not ends:
        return [], sizes
    f = np.array([layer[v][0][j] for v, j in ends])
    b = np.array([layer[v][1][j] for v, j in ends])
    kept, group = _front(f, b)
    heads = np.unique(group, return_index=True)[1]
    chosen = np.unique(group)[_sampled(f[kept[heads]], k, alpha, n, rng.random())]
    out = set()
    for c, g in zip(kept.tolist(), group.tolist(), strict=True):
        if g not in chosen:
            continue
        walk = [(*ends[c], "")]
        for i in range(n, 0, -1):
            walk = [(u, j2, "ACGT"[s] + seq) for v, j, seq in walk for u, s, j2 in back[i - 1][v][j]]
            if max_ties and len(walk) > max_ties:
                walk = sorted(walk, key=lambda x: x[2])[:max_ties]
        out |= {(float(f[c]), float(b[c]), seq) for _, _, seq in walk}
    return sorted(out), sizes


def _machine(transitions: DataFrame, scores: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A machine's edges and scores on the driver: 4 ** m states, sent to every job."""
    rows = scores.select("v", "score").toPandas()
    score = np.zeros(int(rows["v"].max()) + 1)
    score[rows["v"]] = rows["score"]
    return transitions.select("u", "sigma", "v").toPandas().to_numpy(), score


def _cost_array(pdf: pd.DataFrame, n: int) -> np.ndarray:
    cost = np.full((n, 16, 4), np.inf)
    code = {a + b: 4 * i + j for i, a in enumerate("ACGT") for j, b in enumerate("ACGT")}
    cost[pdf["i"] - 1, pdf["ctx"].map(code), pdf["sigma"].map("ACGT".index)] = pdf["cost"]
    return cost


def design_kernel(jobs: DataFrame, transitions: DataFrame, scores: DataFrame, costs: DataFrame, m: int, n: int, k: int = 0, alpha: float = 1.0, seed: int = 0, start: int = 0, max_ties: int = 0) -> DataFrame:
    """``design_frames`` with one task a job. ``max_ties`` bounds the tied sequences of one solution (0: all)."""
    whole = jobs.select("job", F.lit(k).alias("k"), F.lit(float(alpha)).alias("alpha"))
    return design_jobs(whole, transitions, scores, costs.filter(F.col("i") <= n), m, seed, start, max_ties).select("job", "f", "b", "seq")


def design_jobs(jobs: DataFrame, transitions: DataFrame, scores: DataFrame, costs: DataFrame, m: int, seed: int = 0, start: int = 0, max_ties: int = 0) -> DataFrame:
    """(job, k, alpha, f, b, seq) for jobs (job, k, alpha), each as long as its costs, in tasks of their own."""
    edges, score = _machine(transitions, scores)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, k, alpha = int(pdf["i"].max()), int(pdf["k"].iloc[0]), float(pdf["alpha"].iloc[0])
        found, _ = design_job(edges, score, _cost_array(pdf, n), m, n, k, alpha, seed, start, max_ties)
        return pd.DataFrame({"job": pdf["job"].iloc[0], "k": k, "alpha": alpha, "f": [x[0] for x in found], "b": [x[1] for x in found], "seq": [x[2] for x in found]})

    return costs.join(jobs, "job").groupBy("job", "k", "alpha").applyInPandas(run, "job string, k int, alpha double, f double, b double, seq string")


def layer_sizes(transitions: DataFrame, scores: DataFrame, costs: DataFrame, m: int, n: int, start: int = 0) -> DataFrame:
    """(job, i, v, size, pruned) of every state and layer, without sampling; 0 for states that nothing reaches."""
    edges, score = _machine(transitions, scores)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, sizes = design_job(edges, score, _cost_array(pdf, n), m, n, 0, 1.0, 0, start, 1)
        return pd.DataFrame({"job": pdf["job"].iloc[0], "i": [x[0] for x in sizes], "v": [x[1] for x in sizes], "size": [x[2] for x in sizes], "pruned": [x[3] for x in sizes]})

    return costs.groupBy("job").applyInPandas(run, "job string, i int, v long, size int, pruned int")


def write_layers(layers: DataFrame, path: str) -> None:
    """Rows of (i, ...) by layer, so that one layer can be read without the others."""
    layers.repartition("i").write.partitionBy("i").parquet(path)


def read_layer(spark: SparkSession, path: str, i: int) -> DataFrame:
    """The rows of layer ``i``: its folder only, by partition pruning."""
    return spark.read.parquet(path).filter(F.col("i") == i)


def reconstruct(pointers: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """(end, seq) from back-pointers (i, v, j, u, sigma, uj) and final cells (end, v, j): n joins backwards, all ties."""
    walk = ends.select("end", "v", "j", F.lit("").alias("seq"))
    for i in range(n, 0, -1):
        step = pointers.filter(F.col("i") == i).select("v", "j", "u", "sigma", "uj")
        walk = walk.join(step, ["v", "j"]).select("end", F.col("u").alias("v"), F.col("uj").alias("j"), F.concat("sigma", "seq").alias("seq"))
    return walk.select("end", "seq").distinct()


def cost_vectors(sequences: DataFrame, costs: DataFrame) -> DataFrame:
    """(id, i, cost) of every position of (id, job, seq). The context of the first two positions is filled up with A: no
    cost there depends on it, as a codon's third position is the third of the sequence at the earliest."""
    each = sequences.select("id", "job", F.concat(F.lit("AA"), "seq").alias("s"), F.explode(F.sequence(F.lit(1), F.length("seq"))).alias("i"))
    each = each.select("id", "job", "i", F.substring("s", F.col("i"), F.lit(2)).alias("ctx"), F.substring("s", F.col("i") + 2, F.lit(1)).alias("sigma"))
    return each.join(costs, ["job", "i", "ctx", "sigma"]).select("id", "i", "cost")
