"""Motif tables against single motifs, whole lattices and plain convolution; invariants of merging."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from paretide.operators import cost, kmer, machines, motif, motifs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def counts(spark):
    r = random.Random(2)
    made = [(name, i, b, r.randrange(9)) for name, m in (("a", 4), ("b", 4), ("c", 6)) for i in range(m) for b in "ACGT"]
    return spark.createDataFrame(made, "matrix_id string, pos int, base string, count long")


def test_counts_from_windows(spark):
    df = spark.createDataFrame([("x", "ACG"), ("x", "ACG"), ("x", "TTT"), ("y", "AAA"), ("y", "AA"), (None, "CCC")], "k string, kmer string")
    got = {(r["matrix_id"], r["pos"], r["base"]): r["count"] for r in motifs.count_matrices(df, "k", 3).collect()}
    assert len(got) == 36
    assert (got["x", 0, "A"], got["x", 0, "T"], got["x", 1, "G"], got["y", 2, "A"], got[None, 0, "C"]) == (2, 1, 0, 1, 1)


def test_scores_of_a_table_equal_those_of_each_motif(spark, counts):
    scores = motif.pssm(counts)
    for strand in ("forward", "backward", "double"):
        got = {(r["matrix_id"], r["kmer"]): r["score"] for r in motifs.kmer_scores(kmer.lattice(spark, 4), motifs.matrices(scores), 4, strand).collect()}
        for name in "ab":
            w = motif.weights(scores, name)
            want = {r["kmer"]: r["s"] for r in kmer.lattice(spark, 4).select("kmer", motif.score(F.col("kmer"), w, strand).alias("s")).collect()}
            assert all(abs(got[name, k] - s) < 1e-9 for k, s in want.items())
        assert len(got) == 2 * 256
    texts = spark.createDataFrame([(1, "ACGTACGTTT"), (2, ""), (3, None), (4, "ACG")], "id int, seq string")
    table = motifs.matrices(scores).withColumn("least", F.lit(0.5))
    found = motifs.hits(texts, "seq", table, 4)
    want = [(1, n, p + 1) for n in "ab" for p in range(7) if sum(motif.weights(scores, n)[i]["ACGTACGTTT"[p + i]] for i in range(4)) >= 0.5]
    assert rows(found.select("id", "matrix_id", "start")) == sorted(want)
    with pytest.raises(ValueError, match="strand"):
        motifs.kmer_scores(kmer.lattice(spark, 4), table, 4, "both")


def test_distributions_thresholds_and_searches_equal_the_lattice(spark, counts):
    units = motifs.in_units(motif.pssm(counts))
    s = {(r["matrix_id"], r["pos"], r["base"]): r["s"] for r in units.collect()}
    found = {}
    for name, m in (("a", 4), ("b", 4), ("c", 6)):
        for letters in itertools.product("ACGT", repeat=m):
            found.setdefault(name, {})["".join(letters)] = sum(s[name, i, b] for i, b in enumerate(letters))
    dist = motifs.distributions(units)
    for r in dist.collect():
        every = found[r["matrix_id"]].values()
        assert r["p"] == sum(x == r["s"] for x in every) / len(every)
        assert r["tail"] == sum(x >= r["s"] for x in every) / len(every)
    least = motifs.thresholds(dist, 0.05)
    limit = {r["matrix_id"]: r["least"] for r in least.collect()}
    assert rows(motifs.significant(units, least)) == sorted((n, k, x) for n, each in found.items() for k, x in each.items() if x >= limit[n])
    long = units.filter("matrix_id = 'c'").union(units.filter("matrix_id = 'c'").withColumn("pos", F.col("pos") + 6)).union(units.filter("matrix_id = 'c' and pos < 3").withColumn("pos", F.col("pos") + 12))
    tails = motifs.distributions(long)
    assert abs(tails.agg(F.sum("p")).first()[0] - 1) < 1e-12  # 15 letters
    few = motifs.significant(long, motifs.thresholds(tails, 1e-4))
    assert few.count() == round(tails.filter("tail <= 1e-4").agg(F.max("tail")).first()[0] * 4**15)
    assert motifs.distributions(units.limit(0)).count() == 0
    assert motifs.significant(units.limit(0), least).count() == 0


def test_coding_positions_are_linear_and_as_before(spark):
    seq = "*ATG" + "AAA" * 30_000 + "TAG" + "C" * 10
    got = spark.createDataFrame([(seq,)], "s string").select(cost.coding_positions(F.col("s")).alias("c")).first()["c"]
    assert (got["first"], got["last"], got["error"]) == (1, 90_006, None)


def test_invariants_of_merging_find_faults(spark):
    r = random.Random(1)
    scores = spark.createDataFrame([("x", v, float(r.randrange(50))) for v in range(64)], "fsm_id string, v long, score double")
    traces = machines.reduction_traces(scores, 3)
    good = machines.trace_invariants(traces, scores, 3).first()
    assert (good["n_steps"], good["n_states"], good["sums_agree"], good["n_faults"]) == (48, 16, True, 0)
    bad = machines.trace_invariants(traces.withColumn("distance", F.when(F.col("step") == 5, F.col("distance") + 1).otherwise(F.col("distance"))), scores, 3).first()
    assert (bad["sums_agree"], bad["n_faults"]) == (False, 1)
