"""Analytics of scores, hits, reductions and results: summaries, lookups, neighbours, coordinates, reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import in_ranges, with_previous, with_total
from .staging import sized, staged

#: Stretches between gaps that one task scans in ``close_runs``.
STRETCHES = 1000


def five_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, quartiles (linear interpolation) and most of each key; 0 for a key without values."""
    q = {"least": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "most": 1.0}
    return df.groupBy(*keys).agg(*[F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0)).alias(n) for n, p in q.items()])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def pearson_p(r: float | None, n: int) -> float | None:
    """Two-sided chance of a correlation as strong as ``r`` among ``n`` unrelated rows (Student's t with n - 2 degrees)."""
    if r is None or n < 3:
        return None
    a, b, x = n / 2 - 1, 0.5, max(0.0, 1 - r * r)
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of the rows with both values, and their number."""
    return df.dropna(subset=[x, y]).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def correlations(df: DataFrame, x: str, ys: list[str]) -> list[tuple[str, int, float | None, float | None]]:
    """(column, rows with both values, r, p) of each column in one pass."""
    both = lambda y: F.col(x).isNotNull() & F.col(y).isNotNull()
    row = df.agg(*[F.corr(F.when(both(y), F.col(x)), F.when(both(y), F.col(y))).alias(f"r{i}") for i, y in enumerate(ys)], *[F.count_if(both(y)).alias(f"n{i}") for i, y in enumerate(ys)]).first()
    return [(y, row[f"n{i}"], row[f"r{i}"], pearson_p(row[f"r{i}"], row[f"n{i}"])) for i, y in enumerate(ys)]


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of equal widths between the extremes; the last bin has its upper bound."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    return df.dropna(subset=[value]).crossJoin(F.broadcast(ends)).select(F.when(F.col("hi") == F.col("lo"), 0).otherwise(at).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def bucket_counts(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(bucket, n) of left-closed buckets; values outside and nulls are dropped."""
    bucket = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when((F.col(value) >= bounds[i]) & (F.col(value) < bounds[i + 1]), i).otherwise(bucket)
    return df.select(bucket.alias("bucket")).dropna().groupBy("bucket").agg(F.count("*").alias("n"))


def nearest(items: DataFrame, value: str, trace: DataFrame, key: list[str], at: str, order: str) -> DataFrame:
    """``items`` with the row of ``trace`` of the same key whose ``at`` is nearest to ``value``; ties: the first by ``order``.

    One merge of both in order of value: the nearest stands just below or just above, so no row meets all others.
    """
    rest = [c for c in trace.columns if c not in key]
    steps = trace.groupBy(*key, at).agg(F.min_by(F.struct(*rest), order).alias("_t"))
    both = items.withColumn("_x", F.col(value)).withColumn("_t", F.lit(None).cast(steps.schema["_t"].dataType)).unionByName(steps.withColumn("_x", F.col(at)).select(*key, "_x", "_t"), allowMissingColumns=True)
    # both ways as running values: a frame up to the end of a key would be gone through once for each row
    running = lambda *order: Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down, up = running(F.asc("_x"), F.asc_nulls_last("_t")), running(F.desc("_x"), F.desc_nulls_first("_t"))
    both = both.withColumn("_a", F.last("_t", ignorenulls=True).over(down)).withColumn("_b", F.last("_t", ignorenulls=True).over(up))
    found = both.filter(F.col("_t").isNull())
    da, db = F.abs(F.col(f"_a.{at}") - F.col("_x")), F.abs(F.col(f"_b.{at}") - F.col("_x"))
    pick = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull() | (da < db) | ((da == db) & (F.col(f"_a.{order}") <= F.col(f"_b.{order}"))), F.col("_a")).otherwise(F.col("_b"))
    return found.withColumn("_n", pick).select(*items.columns, *[F.col(f"_n.{c}").alias(f"near_{c}") for c in rest])


def reduction_efficiency(traces: DataFrame, key: str, size: int) -> DataFrame:
    """1 - mse at the square root of the largest machine / mse of the smallest; 0 if that is 0, null without such a step."""
    root = int(size**0.5)
    small = F.min_by("mse", "n_states")
    at = F.max(F.when(F.col("n_states") == root, F.col("mse")))
    return traces.groupBy(key).agg(F.when(small == 0, 0.0).otherwise(1 - at / small).alias("efficiency"))


def efficiency_gain(original: Column, reduced: Column) -> Column:
    return F.bround(100 * (1 - reduced / original), 3)


def matched_exactly(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which each row of ``a`` must have exactly one partner; anything else is an error."""
    n = b.groupBy(*keys).agg(F.count("*").alias("_n"))
    ok = a.join(n, keys, "left").withColumn("_ok", F.when(F.col("_n") == 1, True).otherwise(F.raise_error("not exactly one partner").cast("boolean")))
    return ok.filter("_ok").drop("_n", "_ok").join(b, keys)


def close_pairs(states: DataFrame, group: str, score: str, color: str, eps: float) -> DataFrame:
    """Neighbours by score in a group that are at most ``eps`` apart and differ in colour: (group, a, b)."""
    own = Window.partitionBy(group).orderBy(score, "v")
    df = states.withColumn("b", F.lead("v").over(own)).withColumn("_s", F.lead(score).over(own)).withColumn("_c", F.lead(color).over(own))
    return df.filter((F.col("_s") - F.col(score) <= eps) & (F.col("_c") != F.col(color))).select(group, F.col("v").alias("a"), "b")


def close_runs(states: DataFrame, group: str, score: str, rep: str, eps: float) -> DataFrame:
    """(group, run, v, rep): runs of neighbours at most ``eps`` apart that hold each representative once.

    A greedy scan in order of score; every run of two or more is kept, the last of a group too. A gap of more than ``eps``
    always ends a run, so the order is cut there (over ranges, whatever a group's size) and ``STRETCHES`` stretches
    without a gap are one task; run numbers follow from the tasks' counts.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id").reset_index(drop=True)
        label, reps, last, at = [], set(), None, -1
        for s, r in zip(pdf[score], pdf[rep], strict=True):
            if last is None or s - last > eps or r in reps:
                at, reps = at + 1, set()
            reps.add(r)
            label.append(at)
            last = s
        pdf["run"], pdf["_n"] = label, at + 1
        return pdf[[group, "_task", "run", "_n", "v", rep]]

    kinds = dict(states.dtypes)
    rows = with_previous(in_ranges(states.select(group, score, "v", rep), group, [score, "v"]), group, score, "_before")
    rows = with_total(rows, group, F.when(F.col("_before").isNull() | (F.col(score) - F.col("_before") > eps), 1).otherwise(0), "_stretch")
    tasks = rows.withColumn("_task", F.expr(f"(_stretch - 1) div {STRETCHES}")).drop("_before", "_stretch", "_part")
    found = staged(tasks.groupBy(group, "_task").applyInPandas(run, f"`{group}` {kinds[group]}, _task long, run int, _n int, v {kinds['v']}, `{rep}` {kinds[rep]}"), "runs")
    counts = in_ranges(found.groupBy(group, "_task").agg(F.max("_n").alias("_n")), group, ["_task"])
    before = with_total(counts, group, F.col("_n"), "_upto").select(F.col(group).alias("_g"), F.col("_task").alias("_t"), (F.col("_upto") - F.col("_n")).alias("_before"))
    size = F.count("*").over(Window.partitionBy(group, "_task", "run"))
    kept = found.withColumn("_size", size).filter("_size > 1")
    numbered = kept.join(sized(before), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_task") == F.col("_t")))
    return numbered.select(group, (F.col("run") + F.col("_before")).cast("int").alias("run"), "v", rep)


def overlapping_neighbours(hits: DataFrame, key: str) -> DataFrame:
    """Hits that reach into the next one by start: (key, start, stop, next_start)."""
    own = Window.partitionBy(key).orderBy("start", "stop")
    return hits.withColumn("next_start", F.lead("start").over(own)).filter(F.col("stop") >= F.col("next_start")).select(key, "start", "stop", "next_start")


def hit_bucket(n: Column, least: Column) -> Column:
    """0 / 1 / 2-5 / 6+, or with a finer upper end where the least number of hits is over 3."""
    plain = F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").otherwise("6+")
    fine = F.when(n == 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").when(n <= 20, "11-20").otherwise("21+")
    return F.when(least > 3, fine).otherwise(plain)


def bed(hits: DataFrame, region: list[str]) -> DataFrame:
    """(chrom, start, end, name, score, strand): hits in genome coordinates, 0-based and half open, scores from 0 to 1000.

    ``hits`` has the region's chrom, region_start, region_end, region_strand and the hit's start, stop, score, strand.
    """
    own = Window.partitionBy(*region)
    forward = F.col("region_strand") == 1
    first = F.when(forward, F.col("region_start") + F.col("start") - 1).otherwise(F.col("region_end") - F.col("stop") + 1)
    last = F.when(forward, F.col("region_start") + F.col("stop") - 1).otherwise(F.col("region_end") - F.col("start") + 1)
    lo, hi = F.min("score").over(own), F.max("score").over(own)
    scaled = F.when(hi == lo, 1000).otherwise(((F.col("score") - lo) / (hi - lo) * 1000).cast("int"))
    return hits.select("chrom", (first - 1).alias("start"), last.alias("end"), F.col("matched_sequence").alias("name"), scaled.alias("score"), "strand")


def region_chunks(chromosomes: DataFrame, step: int = 1_000_000) -> DataFrame:
    """(chrom, chunk_start, chunk_end) of chromosomes (chrom, length), from 1 and inclusive."""
    starts = F.explode(F.sequence(F.lit(1).cast("long"), F.col("length"), F.lit(step).cast("long")))
    return chromosomes.filter("length > 0").select("chrom", "length", starts.alias("chunk_start")).select("chrom", "chunk_start", F.least(F.col("chunk_start") + step - 1, F.col("length")).alias("chunk_end"))


def genes_in_chunks(chunks: DataFrame, genes: DataFrame, step: int = 1_000_000) -> DataFrame:
    """Genes that overlap a chunk, each once: an equi-join on the cells of ``step`` that both touch, then their bounds."""
    cells = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - 1) / step), F.floor((F.col(b) - 1) / step)))
    touched = genes.withColumn("_c", cells("start", "end")).alias("g")
    own = chunks.select("chrom", "chunk_start", "chunk_end").withColumn("_c", cells("chunk_start", "chunk_end")).alias("k")
    same = (F.col("g.chrom") == F.col("k.chrom")) & (F.col("g._c") == F.col("k._c")) & (F.col("g.start") <= F.col("k.chunk_end")) & (F.col("g.end") >= F.col("k.chunk_start"))
    return touched.join(own, same, "left_semi").select(*genes.columns).dropDuplicates(["gene_id"])


def extended(regions: DataFrame, before: int, after: int, by_strand: bool = True) -> DataFrame:
    """Regions with flanks, not below 1; on the reverse strand the flanks swap unless ``by_strand`` is off."""
    back = F.lit(by_strand) & (F.col("strand") != 1)
    return regions.withColumn("start", F.greatest(F.lit(1).cast("long"), F.col("start") - F.when(back, after).otherwise(before))).withColumn("end", F.col("end") + F.when(back, before).otherwise(after))


def codon_context(pos: Column, first: Column) -> Column:
    """0-based start of the codon around a 0-based position in a region that starts at ``first``."""
    return F.floor((pos - first) / 3) * 3 + first


def substitutions(results: DataFrame, costs: str) -> DataFrame:
    """(id, pos from 1, cost) of the positions with a cost."""
    return results.select("id", F.posexplode(costs).alias("p", "cost")).filter("cost > 0").select("id", (F.col("p") + 1).cast("int").alias("pos"), "cost")


def numbered(results: DataFrame, keys: list[str], f: str) -> DataFrame:
    """Results with ids 001, 002, ... from the best functional score on, and the cost, at least 0."""
    own = Window.partitionBy(*keys).orderBy(F.desc(f), "b", "seq")
    return results.withColumn("id", F.format_string("%03d", F.row_number().over(own))).withColumn("cost", F.greatest(F.lit(0.0), -F.col(f)))


def fewest_hits(results: DataFrame, keys: list[str], hits: str, order: str) -> DataFrame:
    """The first result with the fewest hits of each key."""
    return results.groupBy(*keys).agg(F.min_by("id", F.struct(hits, order)).alias("id"), F.min(hits).alias("n_hits"))


def run_spans(df: DataFrame, order: str, value: str) -> DataFrame:
    """(value, first, rows): runs of equal neighbours in order, as merged table cells need them.

    Rows are dealt by ranges of ``order`` (which names a row), so no window spans the table: runs are found in each
    range, and the ranges' first and last runs, two rows a range, decide which runs go on in the next range.
    """
    parts = df.select(order, value).repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(order)
    marked = parts.withColumn("_new", F.coalesce((~F.lag(value).over(own).eqNullSafe(F.col(value))).cast("int"), F.lit(1)))
    runs = marked.withColumn("_run", F.sum("_new").over(own)).groupBy("_part", "_run", value).agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    last = runs.groupBy("_part").agg(F.max("_run").alias("_last"))
    runs = runs.join(F.broadcast(last), "_part").withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.col("_last")))  # a row for each range
    edges = runs.filter("_edge")  # two rows a range at most, so one window over them is small at any size
    whole = Window.orderBy("first")
    joined = edges.withColumn("_n", F.coalesce((~(F.lag(value).over(whole).eqNullSafe(F.col(value)) & (F.lag("_part").over(whole) < F.col("_part")))).cast("int"), F.lit(1)))
    joined = joined.withColumn("_g", F.sum("_n").over(whole)).groupBy("_g", value).agg(F.min("first").alias("first"), F.sum("rows").alias("rows")).drop("_g")
    return runs.filter(~F.col("_edge")).select(value, "first", "rows").unionByName(joined)


def hits_in_regions(hits: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """``hits`` (key, start, stop) with the ``region`` of the same key that holds them whole; a row for each such pair."""
    inside = (F.col("h.start") >= F.col("r.first")) & (F.col("h.stop") <= F.col("r.last"))
    return hits.alias("h").join(regions.alias("r"), (F.col(f"h.{key}") == F.col(f"r.{key}")) & inside).select("h.*", "r.region", "r.first", "r.last")


def positions_in_regions(rows: DataFrame, regions: list[tuple[int, int]], pos: str) -> DataFrame:
    """``rows`` with is_coding and codon_start: the 0-based start of the codon around a position from 1, null outside.

    ``regions`` (first, last) are the few coding regions of one sequence; the first that holds a position counts.
    """
    p = F.col(pos)
    start, coding = F.lit(None).cast("long"), F.lit(False)
    for first, last in reversed(regions):
        start = F.when(p.between(first, last), first + F.floor((p - first) / 3) * 3 - 1).otherwise(start)
        coding = coding | p.between(first, last)
    return rows.withColumn("is_coding", coding).withColumn("codon_start", start)


def substitution_count(costs: Column) -> Column:
    """Number of positions with a cost."""
    return F.size(F.filter(costs, lambda c: c > 0))


def delta_mse(colored: DataFrame, colorless: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Each coloured result with the MSE of the colourless machine of the same size (exactly one must exist), their
    difference ``delta_mse``, and ``outlier`` where the coloured one is better. ``within``: matrix ids to keep."""
    rows = colored if within is None else colored.filter(F.col("matrix_id").isin(within))
    other = colorless.select("matrix_id", F.col("n_states").alias("n_states_irreducible_fsm"), F.col("binding_mse").alias("colorless_mse"))
    out = matched_exactly(rows, other, ["matrix_id", "n_states_irreducible_fsm"])
    delta = F.col("binding_mse") - F.col("colorless_mse")
    return out.withColumn("delta_mse", delta).withColumn("outlier", delta < 0)


def mse_by_colors(deltas: DataFrame) -> DataFrame:
    """Mean and population deviation of the MSE and of delta-MSE, by number of colours."""
    stat = lambda c, n: [F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std")]
    return deltas.groupBy("number_of_colors").agg(*stat("binding_mse", "mse"), *stat("delta_mse", "delta"), F.count("*").alias("n"))


def state_errors(approx: DataFrame) -> DataFrame:
    """(rep, size, sse, mse): spread of the original scores within each state of a reduced machine."""
    return approx.groupBy("rep").agg(F.count("*").alias("size"), (F.var_pop("score") * F.count("*")).alias("sse"), F.var_pop("score").alias("mse"))


def state_ranks(approx: DataFrame) -> DataFrame:
    """(rep, approx, rank from 0) of the states of a reduced machine by score: one row a state, ties by state. Ranks are
    counted over ranges, so no task has all states."""
    states = approx.groupBy("rep").agg(F.first("approx").alias("approx")).withColumn("_all", F.lit(0))
    ranked = with_total(in_ranges(states, "_all", ["approx", "rep"]), "_all", F.lit(1), "_upto")
    return ranked.select("rep", "approx", (F.col("_upto") - 1).cast("int").alias("rank"))


def strand_efficiencies(efficiencies: DataFrame) -> DataFrame:
    """(motif, double, avg, max) from (motif, strand, efficiency): both single strands against the double strand."""
    one = lambda s: F.max(F.when(F.col("strand") == s, F.col("efficiency")))
    rows = efficiencies.groupBy("motif").agg(one("forward").alias("f"), one("backward").alias("b"), one("double").alias("double"))
    return rows.select("motif", "double", ((F.col("f") + F.col("b")) / 2).alias("avg"), F.greatest("f", "b").alias("max"))


def plot_bounds(df: DataFrame, x: str, y: str) -> DataFrame:
    """Upper bound of x with 5 % room, y's range with 5 % margins, to tens (half to even).

    Fixed values: without rows the bounds are 500, -23500 and -16000.
    """
    span = F.max(y) - F.min(y)
    return df.agg(F.coalesce(F.bround(F.max(x) * 1.05, -1), F.lit(500.0)).alias("x_max"), F.coalesce(F.bround(F.min(y) - 0.05 * span, -1), F.lit(-23500.0)).alias("y_min"), F.coalesce(F.bround(F.max(y) + 0.05 * span, -1), F.lit(-16000.0)).alias("y_max"))


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))
