"""A design run from files to files: target sequences, a motif, costs, a sweep over samplers, numbered results."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics, cost, design, layers, machines, motif, sampling
from .operators.staging import staged
from .sources import files


def machine(counts: DataFrame, matrix_id: str, reduce_by: float | None, least_delta: float = 0.5, strand: str = "double", suffix: int = 2) -> tuple[int, str, DataFrame, DataFrame]:
    """Length, name, transitions and scores of a motif's machine, reduced at the first step that passes both thresholds.

    Without such a step the machine stays as it is.
    """
    m, moves, states = machines.motif_machine(counts, matrix_id, (strand,))
    scores = states.select("v", F.col(strand).alias("score"))
    if reduce_by is None:
        return m, "db_fsm", moves, scores
    traces = machines.reduction_traces(scores.select(F.lit(matrix_id).alias("fsm_id"), "v", "score"), m, suffix)
    picked = machines.pick_reductions(traces, 4**m, least_delta, reduce_by).orderBy("step").first()
    if picked is None:
        return m, "db_fsm", moves, scores
    classes = machines.state_map_at(traces, m, picked["n_states"]).select("v", "rep")
    return m, f"reduced_fsm_{picked['n_states']}", *machines.reduced_machine(moves, classes, scores)


def params_path(alpha: float, beta: float, w: float) -> str:
    """The part of a result's path that names the costs."""
    return f"transition_{alpha:.2f}__transversion_{beta:.2f}__non_synonymous_codon_{w:.2f}"


def run(spark: SparkSession, targets: DataFrame | dict[str, str], counts: DataFrame, matrix_id: str, usage: dict[str, float] | None = None, budgets: tuple[int, ...] = (50, 150, 250), alphas: tuple[float, ...] = (1.0, 0.7, 0.5), reduce_by: float | None = 0.875, p_value: float = 2e-3, max_ties: int = 0, costs: tuple[float, float, float] = (0.5, 1.0, 500.0)) -> DataFrame:
    """(target, sampler, id, cost, binding_score, sequence, costs, n_substitutions, motif_hits) of every run of the sweep.

    ``targets`` are marked sequences (job, seq), as a table or by name. ``usage`` has the costs of codons; without it,
    costs are those of exact match. For each budget and exponent all targets are designed together, layer by layer.
    """
    marked = spark.createDataFrame(list(targets.items()), "job string, seq string") if isinstance(targets, dict) else targets
    whole = staged(cost.targets(marked.select(F.col("job").cast("string").alias("job"), "seq")), "targets")
    alpha, beta, w = costs
    known = F.create_map(*[F.lit(x) for codon, c in (usage or {}).items() for x in (codon, float(c))]) if usage else None
    name, params = ("codons", {"usage": known, "alpha": alpha, "beta": beta, "w": w}) if usage else ("exact", {})
    m, _, moves, scores = machine(counts, matrix_id, reduce_by)
    found = None
    for k in budgets:
        for a in alphas:
            made = layers.design(whole, moves, scores, m, lambda at: cost.COSTS[name](at, **params), k, a, max_ties=max_ties)
            rows = layers.sequences(made, layers.front(made, k, a), max_ties).select("job", F.lit(k).alias("k"), F.lit(float(a)).alias("alpha"), "f", "b", "seq")
            found = rows if found is None else found.unionByName(rows)
    table = cost.target_costs(whole, name, **params)
    named = staged(found, "designs").withColumn("sampler", sampling.sampler_name(F.col("k"), F.col("alpha")))
    rows = analytics.numbered(named, ["job", "sampler"], "f").withColumn("key", F.concat_ws("/", "job", "sampler", "id"))
    # costs by position, in order, of each sequence
    each = design.cost_vectors(rows.select(F.col("key").alias("id"), "job", "seq"), table)
    vectors = each.groupBy(F.col("id").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "cost"))), lambda x: x["cost"]).alias("costs"))
    w_motif = motif.weights(motif.pssm(counts), matrix_id)
    hits = motif.scan_hits(rows.select("key", "seq"), "seq", w_motif, p_value)
    hits = hits.groupBy("key").agg(F.sort_array(F.collect_list(F.array(F.col("start").cast("long"), F.col("stop").cast("long")))).alias("motif_hits"))
    none = F.array().cast("array<array<bigint>>")
    out = rows.join(vectors, "key").join(hits, "key", "left")
    return out.select(F.col("job").alias("target"), "sampler", "id", "cost", F.col("b").alias("binding_score"), F.col("seq").alias("sequence"), "costs", analytics.substitution_count(F.col("costs")).alias("n_substitutions"), F.coalesce("motif_hits", none).alias("motif_hits"))


def design_files(spark: SparkSession, sequences: str, counts: DataFrame, matrix_id: str, out: str, codon_usage: str | None = None, **options) -> None:
    """Read targets (FASTA or plain files with the coding mark) and codon usage, run the sweep, write results under ``out``.

    A folder for each target and sampler holds ``results_metadata`` (JSON) and a file for each sequence.
    """
    targets = files.sequences(spark, sequences).select(F.regexp_replace("name", "\\.[^.]*$", "").alias("job"), F.upper("seq").alias("seq"))
    usage = None
    if codon_usage:
        usage = {r["codon"]: r["cost"] for r in cost.usage_costs(files.codon_usage(spark, codon_usage)).collect()}  # 64 rows
    began = time.perf_counter()
    rows = run(spark, targets, counts, matrix_id, usage, **options).persist()
    for key in rows.groupBy("target", "sampler").count().collect():  # a row for each run of the sweep
        one = rows.filter((F.col("target") == key["target"]) & (F.col("sampler") == key["sampler"]))
        took = analytics.format_duration(F.lit(time.perf_counter() - began))
        meta = F.struct(took.alias("runtime"), F.lit(key["count"]).cast("long").alias("n_solutions"), F.lit(key["target"]).alias("target_id"))
        folder = f"{out}/{key['target']}/{matrix_id}/{key['sampler']}"
        files.write_results(one.withColumn("metadata", meta), f"{folder}/results_metadata")
        files.write_solutions(one, folder)
    rows.unpersist()
