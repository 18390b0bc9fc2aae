"""Operators against literal fixtures, brute force and each other."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paretide.operators import analytics, clustering, cost, design, kmer, machines, motif, sampling
from paretide.operators.skyline import skyline
from paretide.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dominated_points_are_excluded(spark):
    df = spark.createDataFrame([(1.0, 10.0, "p1"), (2.0, 11.0, "p2"), (3.0, 5.0, "p3"), (4.0, 5.0, "p4"), (5.0, 2.0, "p5")], "f double, b double, p string")
    assert rows(skyline(df, [], ["f", "b"])) == [(1.0, 10.0, 1), (3.0, 5.0, 1), (5.0, 2.0, 1)]
    turned = skyline(df.withColumn("f", -F.col("f")), ["f"], ["b"])
    assert rows(turned) == [(-5.0, 2.0, 1), (-3.0, 5.0, 1), (-1.0, 10.0, 1)]


def test_equal_scores_keep_all_payloads(spark):
    df = spark.createDataFrame([(1.0, 10.0, "a"), (1.0, 10.0, "b"), (2.0, 5.0, "c"), (None, 1.0, "d")], "f double, b double, p string")
    assert rows(skyline(df, [], ["f", "b"], payload="p")) == [(1.0, 10.0, 2, ["a", "b"]), (2.0, 5.0, 1, ["c"])]
    assert skyline(df.limit(0), [], ["f", "b"]).count() == 0


def _toy(spark, m, target, usage):
    return spark.createDataFrame([("j",)], "job string"), kmer.transitions(spark, m), spark.range(4**m).select(F.col("id").alias("v"), ((F.col("id") * 5) % 7 - 3).cast("double").alias("score")), cost.costs_frame(spark, {"j": cost.cost_table(target, usage)})


def _brute(m, table, n):
    c = {(i, x, s): v for i, x, s, v in table}
    points = {}
    for letters in itertools.product("ACGT", repeat=n):
        s = "".join(letters)
        f = -sum(c[i + 1, ("AA" + s)[i : i + 2], s[i]] for i in range(n))
        if f == -np.inf:
            continue
        codes = ["ACGT".index(x) for x in s]
        b = sum((sum(codes[i - m + j] * 4 ** (m - 1 - j) for j in range(m)) * 5) % 7 - 3 for i in range(m, n + 1))
        points.setdefault((f, float(b)), []).append(s)
    return sorted((f, b, s) for (f, b), ss in points.items() if not any(f2 >= f and b2 <= b and (f2, b2) != (f, b) for f2, b2 in points) for s in ss)


@pytest.mark.parametrize(("m", "target", "n"), [(2, "GATTA", 5), (3, "*ATGTAA", 6), (2, "A*ATGTGA", 7)])
def test_design_equals_brute_force_in_both_forms(spark, m, target, n):
    usage = {c: 0.25 * (1 + i % 5) for i, c in enumerate(sorted(cost.AMINO_ACIDS))} if "*" in target else None
    args = _toy(spark, m, target, usage)
    want = _brute(m, cost.cost_table(target, usage), n)
    assert rows(design.design_kernel(*args, m, n).select("f", "b", "seq")) == want
    if m == 2 and n == 5:
        assert rows(design.design_frames(*args, m, n).select("f", "b", "seq")) == want


def test_reconstruction_follows_all_ties(spark):
    pointers = spark.createDataFrame([(1, 1, 0, 0, "A", 0), (1, 1, 1, 0, "G", 0), (2, 1, 0, 1, "A", 0), (2, 1, 0, 1, "C", 1)], "i int, v long, j int, u long, sigma string, uj int")
    ends = spark.createDataFrame([("x", 1, 0)], "end string, v long, j int")
    assert rows(design.reconstruct(pointers, ends, 2)) == [("x", "AA"), ("x", "GC")]


def test_cost_vector(spark):
    seqs = spark.createDataFrame([("s", "j", "GAAAG")], "id string, job string, seq string")
    got = rows(design.cost_vectors(seqs, cost.costs_frame(spark, {"j": cost.cost_table("AAAAA", None)})))
    assert [c for *_, c in got] == [1, 0, 0, 0, 1]


def test_coding_positions(spark):
    df = spark.createDataFrame([("CC*ATGAAATAAG",), ("*ATGAAA",), ("*ATG*TAA",), ("*CCCTAA",), ("ACGT",)], "s string").select("s", cost.coding_positions(F.col("s")).alias("c")).select("s", "c.*")
    got = {r["s"]: (r["first"], r["last"], r["error"]) for r in df.collect()}
    assert got["CC*ATGAAATAAG"] == (3, 11, None)
    assert [got[s][2] for s in ("*ATGAAA", "*ATG*TAA", "*CCCTAA", "ACGT")] == ["no stop codon", "more than one marker", "no start codon", None]
    assert cost.python_positions("CC*ATGAAATAAG")[1] == [0, 0, 1, 2, -3, 1, 2, 3, 1, 2, 3, 0]
    for bad in ("*ATGAAA", "*ATG*TAA", "*CCCTAA"):
        with pytest.raises(ValueError, match="codon|marker"):
            cost.python_positions(bad)


def test_sampling_equals_pointers(spark):
    r = random.Random(3)
    f = sorted((-r.random() * 50 for _ in range(60)), reverse=True)
    df = spark.createDataFrame([("k", x, float(i)) for i, x in enumerate(f)], "k string, f double, b double")
    w = np.power(-np.array(f) / 10 + 1, -0.7)
    cum = np.cumsum(w)
    want = sorted({int(i) for i in np.searchsorted(cum, (0.4 + np.arange(9)) * cum[-1] / 9)})
    got = sampling.universal(df, ["k"], "f", [F.desc("f"), F.asc("b")], 9, 0.7, 10, 0.4)
    assert sorted(int(x["b"]) for x in got.collect()) == want
    assert sampling.universal(df, ["k"], "f", [F.desc("f")], 0, 0.7, 10, 0.4).count() == 60
    assert sampling.phase_sampler(df, ["k"], [F.desc("f")], 5, "upstream").count() <= 5


@pytest.mark.parametrize("suffix", [0, 1, 2])
def test_colored_machine_is_valid(spark, suffix):
    r = random.Random(suffix)
    states = spark.createDataFrame([(v, r.randrange(2)) for v in range(64)], "v long, color int")
    classes = machines.colored_classes(states, 3, suffix)
    assert machines.violations(kmer.transitions(spark, 3), classes, states, suffix).count() == 0


def test_greedy_merging_ends_at_the_suffix_machine_and_sums_errors():
    r = random.Random(1)
    score = [r.random() for _ in range(64)]
    trace = machines.greedy_merges(score, 3, 1)
    assert trace[-1][4] == 4
    rep = list(range(64))
    for _, a, b, *_ in trace:
        rep = [a if x == b else x for x in rep]
    means = {x: np.mean([score[v] for v in range(64) if rep[v] == x]) for x in set(rep)}
    assert np.isclose(np.mean([(score[v] - means[rep[v]]) ** 2 for v in range(64)]), trace[-1][5])
    for u in range(64):  # equivalent states move to equivalent states
        assert all(rep[(u * 4 + s) % 64] == rep[(rep[u] * 4 + s) % 64] for s in range(4))


def test_optimal_clustering_equals_brute_force():
    r = np.random.default_rng(0)
    for k in (1, 2, 3):
        x, w = np.sort(r.random(8)), r.integers(1, 4, 8).astype(float)
        sse = lambda label: sum(np.sum(w[label == c] * (x[label == c] - np.average(x[label == c], weights=w[label == c])) ** 2) for c in set(label.tolist()))
        best = min(sse(np.searchsorted(np.array(cuts), np.arange(8), side="right")) for cuts in itertools.combinations(range(1, 8), k - 1)) if k > 1 else sse(np.zeros(8, int))
        assert np.isclose(sse(clustering.optimal_1d(x, w, k)), best)


def test_motif_threshold_and_strands(spark):
    counts = spark.createDataFrame([("t", i, b, n) for i in range(2) for b, n in zip("ACGT", ((9, 1, 1, 1), (1, 1, 9, 1))[i], strict=True)], "matrix_id string, pos int, base string, count long")
    w = motif.weights(motif.pssm(counts), "t")
    assert motif.significant_patterns(spark, w, motif.threshold_for(spark, w, 1 / 16)).first()["kmer"] == "AG"
    hits = motif.hits(spark.createDataFrame([(1, "AGCT"), (2, ""), (3, None)], "id int, s string"), "s", w, 2.0)
    assert rows(hits.select("id", "start", "stop")) == [(1, 1, 2), (1, 3, 4)]


def test_runs_lookup_and_formats(spark):
    states = spark.createDataFrame([("g", 1, 0.0, 1), ("g", 2, 0.5, 2), ("g", 3, 0.9, 1), ("g", 4, 5.0, 1), ("h", 5, 0.0, 1), ("h", 6, 0.1, 2)], "g string, v long, s double, r int")
    assert [x[:3] for x in rows(analytics.close_runs(states, "g", "s", "r", 1.0))] == [("g", 0, 1), ("g", 0, 2), ("h", 0, 5), ("h", 0, 6)]
    assert spark.range(1).select(analytics.format_duration(F.lit(3725.9)).alias("t")).first()["t"] == "01:02:05"
    got = spark.createDataFrame([("abc", "abd"), ("a", "a"), ("x", "y")], "a string, b string").select(kmer.longest_common_prefix(F.col("a"), F.col("b")).alias("n"))
    assert [r["n"] for r in got.collect()] == [2, 1, 0]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text(">x\nACG\nT\n>y\nGG\n")
    (tmp_path / "usage.txt").write_text("AUG 0.5\n\nccc 0.25\n")
    assert rows(files.sequences(spark, str(tmp_path / "a.txt"))) == [("a.txt", "ACGTGG")]
    assert [(r["header"], r["seq"]) for r in files.fasta_records(spark, str(tmp_path / "a.txt")).collect()] == [("x", "ACGT"), ("y", "GG")]
    assert rows(files.codon_usage(spark, str(tmp_path / "usage.txt"))) == [("ATG", 0.5), ("CCC", 0.25)]
    (tmp_path / "bad.txt").write_text("AXG 0.5\n")
    with pytest.raises(Exception, match="bad codon line"):
        files.codon_usage(spark, str(tmp_path / "bad.txt")).collect()
    files.write_fasta(spark.createDataFrame([("r", "A" * 130)], "header string, seq string"), str(tmp_path / "fa"))
    assert files.fasta_records(spark, str(tmp_path / "fa")).first()["seq"] == "A" * 130
    bed = spark.createDataFrame([("1", 5, 8, "n", 1000, "+"), ("1", 1, 3, "m", 0, "-")], "chrom string, start long, end long, name string, score int, strand string")
    files.write_bed(bed, str(tmp_path / "bed"), "t")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "bed")).collect()] == ['track name="t"', "1\t1\t3\tm\t0\t-", "1\t5\t8\tn\t1000\t+"]
