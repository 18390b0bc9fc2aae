"""Steps that must grow no faster than their input, and odd values that ended a job."""

import collections
import random

import pyarrow as pa
from pyspark.sql import functions as F

from paretide.operators import analytics, clustering, cost, kmer, machines
from paretide.plans import io_queries, queries
from paretide.sources import files


def test_a_picked_step_may_have_no_states(spark):
    traces = spark.createDataFrame([("m", i, 3 - i, 3.0 * i) for i in range(1, 8)], "fsm_id string, step int, n_states int, mse double")
    got = [tuple(r) for r in machines.pick_reductions(traces, 3, 2.0, 0.1).orderBy("step").collect()]
    # step 3 has 0 states; the next one passes both thresholds against it, later ones have more below 0 than the picked one
    assert got == [("m", 1, 2, 3.0), ("m", 2, 1, 6.0), ("m", 3, 0, 9.0), ("m", 4, -1, 12.0)]


def test_nearest_is_a_running_value_both_ways(spark):
    r = random.Random(3)
    items = [(i, r.choice("ab"), float(r.randrange(60))) for i in range(300)] + [(300, "c", 1.0)]
    steps = [(k, s, float(r.randrange(0, 60, 3))) for k in "ab" for s in range(15)]
    trace = spark.createDataFrame(steps, "k string, step int, mse double")
    out = analytics.nearest(spark.createDataFrame(items, "id int, k string, x double"), "x", trace, ["k"], "mse", "step")
    got = {x["id"]: (x["near_step"], x["near_mse"]) for x in out.collect()}
    for i, k, x in items:
        own = [(abs(mse - x), s, mse) for key, s, mse in steps if key == k]
        assert got[i] == (min(own)[1:] if own else (None, None))
    # Spark goes through such a frame from each row on to its end
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()


def test_differences_are_formed_once_a_pair_of_classes(spark):
    r = random.Random(8)
    maps = [{v: min(v, r.randrange(k)) for v in range(400)} for k in (3, 4)]
    frames = [spark.createDataFrame(list(m.items()), "v long, rep long") for m in maps]
    a, b = maps
    want = {}
    for v in a:
        one, other = [u for u in a if a[u] == a[v]], [u for u in a if b[u] == b[v]]
        only = lambda own, m: [(c, [u for u in own if m[u] == c]) for c in sorted({m[u] for u in own}) if c != m[v]]  # noqa: B023, E731
        want[v] = (a[v], b[v], [u for u in one if b[u] == b[v]], only(one, b), only(other, a))
    plain = lambda x: [(y["other"], y["members"]) for y in x]
    got = clustering.reduction_diff(*frames)
    assert {x["v"]: (x["first"], x["second"], x["shared"], plain(x["only_first"]), plain(x["only_second"])) for x in got.collect()} == want
    assert clustering.class_diffs(*frames).count() == len(set(zip(a.values(), b.values(), strict=True)))
    # no shuffle or sort after the join that gives each state its members
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") and "Exchange" not in plan.split("SortMergeJoin")[0]


def test_the_text_of_a_pair_of_classes_is_written_once(spark, tmp_path):
    rows = [(10**15 + i, f"b{i % 20}", i // 20 % 24) for i in range(7200)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        queries.reduction_diff(spark, str(tmp_path)).write.option("compression", "none").parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    out = spark.read.parquet(f"{tmp_path}/out")
    # 80 MB of text, a 15th of it different: if a task had more than the 1 MB of a writer's dictionary, each state would get its own
    assert out.agg(F.count("*"), F.countDistinct("v"), F.sum(F.length("only_first") + F.length("only_second")) > 75e6).first()[:] == (7200, 7200, True)
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 10e6, size


def test_a_task_has_one_wide_pair_or_narrow_ones(spark, monkeypatch):
    monkeypatch.setattr(clustering, "TASK_BYTES", 1000)
    r = random.Random(4)
    a, b = ({v: min(v, int(r.expovariate(0.4))) for v in r.sample(range(700), 600)} for _ in range(2))
    frames = [spark.createDataFrame(list(m.items()), "v long, rep long") for m in (a, b)]
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["other"], F.array_join(x["members"], ","))), ";")
    lines = [F.array_join("shared", ",").alias("shared"), line("only_first").alias("only_first"), line("only_second").alias("only_second")]
    got = clustering.reduction_diff(*frames, lines).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((x["v"], x["first"], x["second"]) for x in got) == sorted((v, a[v], b[v]) for v in a if v in b)
    pairs = {(x["task"], x["first"], x["second"]): len(x["shared"] + x["only_first"] + x["only_second"]) for x in got}
    assert len(pairs) == len({p[1:] for p in pairs})
    tasks = collections.defaultdict(list)
    for (t, _, _), width in pairs.items():
        tasks[t].append(width)
    assert all(len(w) == 1 or sum(w) <= 1000 for w in tasks.values())
    assert any(len(w) > 1 for w in tasks.values()) and any(w[0] > 1000 for w in tasks.values())


def test_states_of_one_pair_are_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(clustering, "SLICE_BYTES", 3000)
    frames = [spark.createDataFrame([(v, v // k * k) for v in range(100, 200)], "v long, rep long") for k in (100, 100)]
    frames[1] = frames[1].unionByName(spark.createDataFrame([(7, 5)], "v long, rep long"))
    got = clustering.reduction_diff(*frames).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((x["v"], x["first"], x["second"], tuple(x["shared"]), *x["only_first"], *x["only_second"]) for x in got) == [(v, 100, 100, tuple(range(100, 200))) for v in range(100, 200)]
    rows = collections.Counter(x["task"] for x in got)
    assert len(rows) > 20 and max(rows.values()) * 400 <= 3000
    assert clustering.class_diffs(*frames).count() == 1


def test_a_written_difference_has_each_state_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"b{i % 3}", i % 4) for i in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    at = []
    monkeypatch.setattr(files, "write_json", lambda df, path: (at.append(path), df.write.json(path)))
    got = {x["v"]: (x["n_shared"], x["n_only_first"]) for x in io_queries.reduction_diff_sink(spark, str(tmp_path)).collect()}
    assert got == {i: (50, 150) for i in range(600)}
    assert sum(len(x["members"]) for x in spark.read.json(at[0]).collect()) == len(rows)


def test_counts_equal_windows_and_make_no_row_a_window(spark, monkeypatch):
    r = random.Random(5)
    rows = [(r.choice(["x", "y", None]), "".join(r.choice("ACGTN" if i % 9 == 0 else "ACGT") for _ in range(r.randrange(60)))) for i in range(200)] + [("x", None), ("y", "")]
    monkeypatch.setattr(kmer, "LETTERS", 50)
    df = spark.createDataFrame(rows, "k string, seq string")
    for m in (1, 3, 6):
        for bins in (1 << 22, 0):
            monkeypatch.setattr(kmer, "BINS", bins)
            want = collections.Counter((k, s[i : i + m]) for k, s in rows for i in range(len(s or "") - m + 1) if "N" not in s[i : i + m])
            batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([s for _, s in rows])], names=["key", "seq"])
            got = collections.Counter()
            for b in kmer._counted(iter([batch, batch.slice(3, 0)]), m):
                for x in b.to_pylist():
                    got[x["key"], "".join("ACGT"[x["code"] // 4**i % 4] for i in reversed(range(m)))] += x["n"]
            assert got == want
    out = kmer.counts(df, "seq", 3, "k")
    assert {(x["k"], x["kmer"]): x["n"] for x in out.collect()} == collections.Counter((k, s[i : i + 3]) for k, s in rows for i in range(len(s or "") - 2) if "N" not in s[i : i + 3])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_cost_totals_equal_the_costs_of_all_positions(spark):
    rows = spark.createDataFrame([("a", "ATGGCCTAA", 1, 9), ("b", "CCATGAAANTAGG", 3, 12), ("c", "AC", None, None), ("d", "", None, None)], "job string, seq string, first int, last int")
    usage = F.create_map(*[F.lit(x) for c in cost.AMINO_ACIDS for x in (c, 0.25)])
    for name, params in (("exact", {}), ("codons", {"usage": usage})):
        part = rows.filter("job <> 'b'") if name == "codons" else rows
        want = {}
        for x in cost.target_costs(part, name, **params).collect():
            want.setdefault((x["job"], x["sigma"]), []).append(x["cost"])
        finite = lambda c: [x for x in c if x < float("inf")]
        got = cost.cost_totals(part, name, **params)
        assert {(x["job"], x["sigma"]): (x["n"], x["n_forbidden"], x["total"], x["most"]) for x in got.collect()} == {k: (len(c), len(c) - len(finite(c)), sum(finite(c)), max(finite(c))) for k, c in want.items()}


def test_a_large_target_has_several_documents(spark, tmp_path):
    rows = spark.range(900).select(F.col("id").cast("string").alias("id"), F.lit(1.0).alias("cost"), F.lit(2.0).alias("binding_score"), F.lit("A").alias("sequence"), F.array(F.lit(0.0)).alias("costs"), F.lit(0).alias("n_substitutions"), F.array(F.array(F.lit(1), F.lit(2))).alias("motif_hits"), F.when(F.col("id") < 800, "a").otherwise("b").alias("t"))
    meta = F.struct(F.lit("x").alias("runtime"), F.when(F.col("t") == "a", 800).otherwise(100).alias("n_solutions"), F.col("t").alias("target_id"))
    files.write_results(rows.withColumn("metadata", meta).drop("t"), f"{tmp_path}/r", 100)
    documents = spark.read.json(f"{tmp_path}/r", schema=files.RESULTS, multiLine=True).collect()
    assert len(documents) == 9 and max(len(x["results"]) for x in documents) < 200
    assert all([y["id"] for y in x["results"]] == sorted(y["id"] for y in x["results"]) for x in documents)
    back = files.results(spark, f"{tmp_path}/r").select("metadata.target_id", "metadata.n_solutions", "id").collect()
    assert sorted(map(tuple, back)) == sorted(("a", 800, str(i)) if i < 800 else ("b", 100, str(i)) for i in range(900))
