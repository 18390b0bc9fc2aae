"""One-dimensional clustering of scores into colours, and comparison of partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges
from .staging import staged

#: Bytes of text of the pairs of classes that a task shares among its states. Parquet keeps each text of a column once while
#: they are no more than 1 MB; after that it may hold thousands of rows, as wide as they are, before it looks at their size.
TASK_BYTES = 512 * 1024
#: Bytes of rows that a task forms of one pair, whose states are dealt to several tasks beyond it.
SLICE_BYTES = 1 << 30


def optimal_1d(values: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Labels (in order of value) of the split of sorted distinct values into ``k`` runs with the least squared error."""
    n = len(values)
    k = min(k, n)
    w, wx, wxx = (np.append(0.0, np.cumsum(a)) for a in (weights, weights * values, weights * values * values))

    def sse(i: np.ndarray | int, j: int) -> np.ndarray:
        mass = w[j] - w[i]
        return np.maximum(wxx[j] - wxx[i] - (wx[j] - wx[i]) ** 2 / np.where(mass > 0, mass, 1), 0)

    best = np.append(0.0, np.array([sse(0, j) for j in range(1, n + 1)]))
    cuts = []
    for c in range(2, k + 1):
        # the best cut moves right with the end, so halves of the ends search only their part of the cuts
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        work = [(c, n, c - 1, n - 1)]
        while work:
            lo, hi, first, last = work.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = best[i] + sse(i, j)
            at = int(np.argmin(total))
            new[j], cut[j] = total[at], i[at]
            work += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        best = new
        cuts.append(cut)
    label = np.zeros(n, dtype=int)
    end = n
    for c in range(k - 1, 0, -1):
        start = int(cuts[c - 1][end])
        label[start:end] = c
        end = start
    return label


def kmeans_1d(scores: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The rows with ``color``: the optimal split of each key's values. Equal values are one weighted point."""
    points = scores.groupBy(key, value).agg(F.count("*").alias("_w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value)
        pdf["color"] = optimal_1d(pdf[value].to_numpy(float), pdf["_w"].to_numpy(float), k)
        return pdf[[key, value, "color"]]

    kinds = dict(scores.dtypes)
    labels = points.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{value}` {kinds[value]}, color int")
    return scores.join(labels, [key, value])


def kmeans_polar(scores: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """Negative values in k // 3 colours, the others in the rest, each side by the optimal split. With fewer than three
    colours there is none for the negative side: that is an error if it has values."""
    if k < 3:
        if scores.filter(F.col(value) < 0).limit(1).count():
            raise ValueError("three colours at least for values on both sides of 0")
        return kmeans_1d(scores, key, value, k)
    low = kmeans_1d(scores.filter(F.col(value) < 0), key, value, k // 3)
    high = kmeans_1d(scores.filter(F.col(value) >= 0), key, value, k - k // 3)
    return low.unionByName(high.withColumn("color", F.col("color") + k // 3))


def kmeans_lloyd(scores: DataFrame, value: str, k: int, seed: int = 0) -> DataFrame:
    """The library's k-means on one column; its labels have no order."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[value], outputCol="_x").transform(scores)
    return KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="color").fit(rows).transform(rows).drop("_x")


def partition(scores: DataFrame, key: str, value: str, k: int, method: str = "kmeans1d") -> DataFrame:
    """Dispatch by name."""
    if method == "kmeans1d":
        return kmeans_1d(scores, key, value, k)
    if method == "kmeans-polar_2":
        return kmeans_polar(scores, key, value, k)
    if method == "kmeans":
        return kmeans_lloyd(scores, value, k)
    raise ValueError(f"unknown method {method}")


def split_partitions(scores: DataFrame, value: str, color: str, k: int) -> DataFrame:
    """Split the bin of largest variance in two until there are ``k``; labels follow the values. One pass a split."""
    out = scores
    while True:
        bins = out.groupBy(color).agg(F.var_pop(value).alias("v"), F.countDistinct(value).alias("n")).orderBy(F.desc("v"), color).collect()  # a row for each colour
        widest = next((b for b in bins if b["n"] > 1), None)
        if len(bins) >= k or widest is None:
            return out
        one = F.col(color) == widest[color]
        halves = kmeans_1d(out.filter(one).select(F.lit(0).alias("_k"), F.col(value)).distinct(), "_k", value, 2).select(value, F.col("color").alias("_half"))
        out = out.withColumn(color, F.when(F.col(color) > widest[color], F.col(color) + 1).otherwise(F.col(color)))
        out = out.join(halves, value, "left").withColumn(color, F.when(F.col(color) == widest[color], F.col(color) + F.coalesce("_half", F.lit(0))).otherwise(F.col(color))).drop("_half")


def join_partitions(scores: DataFrame, value: str, color: str, k: int) -> DataFrame:
    """Merge the neighbouring bins whose union adds least variance until there are ``k``. Sums of bins decide."""
    rows = scores.groupBy(color).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.pow(value, F.lit(2))).alias("q")).orderBy(color).collect()  # a row for each colour
    bins = [([r[color]], r["n"], r["s"], r["q"]) for r in rows]
    var = lambda b: b[3] / b[1] - (b[2] / b[1]) ** 2
    while len(bins) > k:
        merged = [(a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3]) for a, b in zip(bins, bins[1:], strict=False)]
        at = min(range(len(merged)), key=lambda i: var(merged[i]) - var(bins[i]) - var(bins[i + 1]))
        bins[at : at + 2] = [merged[at]]
    names = F.create_map(*[F.lit(x) for i, b in enumerate(bins) for c in b[0] for x in (c, i)])
    return scores.withColumn(color, names[F.col(color)])


def partition_sse(scores: DataFrame, value: str, color: str) -> DataFrame:
    """Sum over the bins of size times variance."""
    return scores.groupBy(color).agg((F.count("*") * F.var_pop(value)).alias("_s")).agg(F.sum("_s").alias("sse"))


def bin_report(scores: DataFrame, value: str, color: str) -> DataFrame:
    return scores.groupBy(color).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of two labellings."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def mismatches(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.count_if(F.col(a) != F.col(b)).alias("n_mismatch"), F.count("*").alias("n"))


def compare_reductions(a: DataFrame, b: DataFrame) -> DataFrame:
    """(first, second, n, members): the states (v, rep) that a class of one map and a class of the other share.

    A row for each pair of classes that meet, so the result is no larger than the maps. States of one map only have
    null on the other side.
    """
    both = a.select("v", F.col("rep").alias("first")).join(b.select("v", F.col("rep").alias("second")), "v", "full_outer")
    return both.groupBy("first", "second").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("members"))


def _tasks(pairs: DataFrame) -> tuple[DataFrame, int]:
    """(_task, first, second, _slice, states) of the ``pairs`` with both classes, and the number of tasks. A task has pairs of
    ``TASK_BYTES`` of text in all, or one pair, or a slice of one pair's states if their rows are more than ``SLICE_BYTES``.
    Widths are summed in order, one of more than ``TASK_BYTES`` as that; the sums fall into windows of this size, and a pair
    that leaves the window in which it begins has a number between those of both, alone."""
    def text(own: str, other: str, name: str) -> DataFrame:
        width = F.octet_length(F.array_join(F.col("members").cast("array<string>"), ",")) + F.coalesce(F.octet_length(F.col(other).cast("string")), F.lit(0)) + 2
        return pairs.groupBy(own).agg(F.sum(width).alias(name))

    wide = pairs.select("first", "second", "n").join(text("first", "second", "_a"), "first").join(text("second", "first", "_b"), "second")
    wide = wide.withColumn("_slices", F.least("n", F.ceil(F.col("n") * ((F.col("_a") + F.col("_b")) / SLICE_BYTES))))
    width = F.when(F.col("_slices") > 1, TASK_BYTES).otherwise(F.least(F.col("_a") + F.col("_b"), F.lit(TASK_BYTES)))
    rows = wide.select("first", "second", F.lit(0).alias("_all"), width.alias("_width"), "_slices", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"))
    summed = ranges.with_total(ranges.in_ranges(rows, "_all", ["first", "second", "_slice"]), "_all", F.col("_width"), "_end")
    window = lambda at: F.floor(at / TASK_BYTES)
    task = (window(F.col("_end") - F.col("_width")) + window(F.col("_end") - 1)).cast("int").alias("_task")
    begin = lambda k: F.floor(k * (F.col("n") / F.col("_slices"))).cast("int")
    states = F.slice("members", begin(F.col("_slice")) + 1, F.when(F.col("_slice") + 1 < F.col("_slices"), begin(F.col("_slice") + 1)).otherwise(F.col("n").cast("int")) - begin(F.col("_slice")))
    at = summed.select(task, "first", "second", "_slice", "_slices").join(pairs.select("first", "second", "n", "members"), ["first", "second"])
    tasks = staged(at.select("_task", "first", "second", "_slice", states.alias("states")), "tasks")
    return tasks, (tasks.agg(F.max("_task")).first()[0] or 0) + 1


def _dealt(df: DataFrame, n: int) -> DataFrame:
    return df.repartitionById(n, F.col("_task")).hint("shuffle_merge")


def _class_diffs(pairs: DataFrame, tasks: DataFrame, n: int) -> DataFrame:
    """The columns of ``class_diffs`` and ``_task``, dealt by it."""
    def rest(own: str, other: str, name: str) -> DataFrame:
        each = pairs.filter(F.col(own).isNotNull()).groupBy(own).agg(F.sort_array(F.collect_list(F.struct(F.col(other).alias("other"), "members"))).alias("_all"))
        return _dealt(tasks.select("_task", "first", "second").join(each, own).select("_task", "first", "second", F.filter("_all", lambda x: ~x["other"].eqNullSafe(F.col(other))).alias(name)), n)

    shared = pairs.select("first", "second", F.col("members").alias("shared"))
    shared, own = _dealt(tasks.select("_task", "first", "second").join(shared, ["first", "second"]).select("_task", "first", "second", "shared"), n), ["_task", "first", "second"]
    return shared.join(rest("first", "second", "only_first"), own).join(rest("second", "first", "only_second"), own)


def class_diffs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(first, second, shared, only_first, only_second) of each class of ``a`` and class of ``b`` that meet: the members
    shared, and the members in one of them only, by their class in the other map (arrays of (other class, members), in
    order). All states of such a pair differ alike, so this has a row for each pair and is as large as the maps times
    their numbers of classes."""
    pairs = staged(compare_reductions(a, b), "pairs")
    tasks, n = _tasks(pairs)
    return _class_diffs(pairs, tasks.filter("_slice = 0"), n).drop("_task")


def reduction_diff(a: DataFrame, b: DataFrame, columns: list[Column | str] | None = None) -> DataFrame:
    """For each state ``v`` of two maps: its class in both, and ``columns`` over those of ``class_diffs`` for them (all,
    unless given), formed once a pair. The join with the states is the last step: what follows it works on a row as wide as
    two classes for each state, the square of a class in all. A task has states of one wide pair, or pairs that are narrow
    together, so a writer with a dictionary writes, and holds, a text once a pair."""
    pairs = staged(compare_reductions(a, b), "pairs")
    tasks, n = _tasks(pairs)
    own = ["_task", "first", "second"]
    diffs = _class_diffs(pairs, tasks, n).select(*own, *(columns or ["shared", "only_first", "only_second"]))
    # not exploded from the diffs: that would hold all rows of a pair at a time
    states = _dealt(tasks.select(*own, F.explode("states").alias("v")), n)
    return states.join(diffs.hint("shuffle_merge"), own).select("v", *[c for c in diffs.columns if c != "_task"])


def patterns_per_bin(scores: DataFrame, pattern: str, color: str, k: int) -> DataFrame:
    """(color, n, patterns) of each of ``k`` colours; an empty one has 0 and an empty list."""
    bins = scores.sparkSession.range(k).select(F.col("id").cast("int").alias("_c"))
    found = scores.groupBy(F.col(color).cast("int").alias("_c")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(pattern)).alias("patterns"))
    none = F.array().cast(found.schema["patterns"].dataType)
    return bins.join(found, "_c", "left").select(F.col("_c").alias(color), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("patterns", none).alias("patterns"))


def full_bin_report(scores: DataFrame, value: str, color: str, k: int) -> DataFrame:
    """``bin_report`` with a row for each of ``k`` colours: 0 and nulls where a colour has no values."""
    bins = scores.sparkSession.range(k).select(F.col("id").cast("int").alias(color))
    report = bin_report(scores, value, color).withColumn(color, F.col(color).cast("int"))
    return bins.join(report, color, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def partition_to_colors(scores: DataFrame, key: str, value: str, k: int, method: str = "kmeans1d", origin: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The rows with ``color`` in ``k`` colours: directly, or from ``origin`` colours by splitting or joining; and then
    also the direct partition as a baseline. ``key`` has one value."""
    start = partition(scores, key, value, origin or k, method)
    if origin is None or origin == k:
        return start, None
    changed = split_partitions(start, value, "color", k) if origin < k else join_partitions(start, value, "color", k)
    return changed, partition(scores, key, value, k, method)


def prefix_clusters(items: DataFrame, key: str, seq: str, share: float) -> DataFrame:
    """(key, seq, cluster): in sorted order a run starts where the next shares at least ``share`` of the shorter as a
    prefix, and takes the rows that begin with it; -1 if alone. A greedy scan, one task a key."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq).reset_index(drop=True)
        s, label, i, n = pdf[seq].tolist(), [-1] * len(pdf), 0, 0
        while i < len(s):
            common = ""
            if i + 1 < len(s):
                size = next((j for j, (x, y) in enumerate(zip(s[i], s[i + 1], strict=False)) if x != y), min(len(s[i]), len(s[i + 1])))
                if size and size >= share * min(len(s[i]), len(s[i + 1])):
                    common = s[i][:size]
            j = i + 1
            while common and j < len(s) and s[j].startswith(common):
                j += 1
            if j > i + 1:
                label[i:j] = [n] * (j - i)
                n += 1
            i = j
        pdf["cluster"] = label
        return pdf[[key, seq, "cluster"]]

    kinds = dict(items.dtypes)
    return items.select(key, seq).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{seq}` {kinds[seq]}, cluster int")


def rank_cooccurrence(df: DataFrame, cluster: str, rank: str) -> DataFrame:
    """(a, b, n): in how many pairs of a cluster's members the ranks a and b meet, by counts, not by pairs of rows."""
    n = df.groupBy(cluster, rank).agg(F.count("*").alias("c"))
    x, y = n.select(cluster, F.col(rank).alias("a"), F.col("c").alias("ca")), n.select(cluster, F.col(rank).alias("b"), F.col("c").alias("cb"))
    return x.join(y, cluster).groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("n"))
