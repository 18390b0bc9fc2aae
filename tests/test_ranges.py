"""Ordered scans over ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from paretide.operators import analytics, ranges


def test_previous_rows_and_totals_over_many_ranges(spark):
    r = random.Random(6)
    rows = [(g, r.randrange(40), i, r.randrange(5)) for i in range(900) for g in (["a"] if i % 3 else ["a", "b", None])]
    df = spark.createDataFrame(rows, "g string, x int, v int, n int").repartition(7)
    got = ranges.in_ranges(df, "g", ["x", "v"], 6)
    got = ranges.with_total(ranges.with_previous(got, "g", "x", "before"), "g", F.col("n"), "total")
    assert got.select("_part").distinct().count() > 1
    found = {(x["g"], x["v"]): (x["before"], x["total"]) for x in got.collect()}
    for g in ("a", "b", None):
        before, total = None, 0
        for _, x, v, n in sorted((row for row in rows if row[0] == g), key=lambda row: row[1:3]):
            total += n
            assert found[g, v] == (before, total)
            before = x


@pytest.mark.parametrize("stretches", [1, 3, 1000])
def test_runs_are_cut_at_gaps(spark, monkeypatch, stretches):
    monkeypatch.setattr(analytics, "STRETCHES", stretches)
    r = random.Random(9)
    rows = [(g, i, round(r.random() * 60, 2), r.randrange(6)) for i in range(500) for g in "gh"[: 1 + i % 2]]
    want = []
    for g in "gh":
        last, reps, run, each = None, set(), -1, {}
        for _, v, s, rep in sorted((row for row in rows if row[0] == g), key=lambda row: (row[2], row[1])):
            if last is None or s - last > 0.3 or rep in reps:
                run, reps = run + 1, set()
            reps.add(rep)
            each.setdefault(run, []).append((g, run, v, rep))
            last = s
        want += [x for own in each.values() if len(own) > 1 for x in own]
    df = spark.createDataFrame(rows, "g string, v long, s double, r int")
    assert sorted(map(tuple, analytics.close_runs(df, "g", "s", "r", 0.3).collect())) == sorted(want)


def test_ranks_over_ranges(spark):
    r = random.Random(2)
    rows = [(i, float(r.randrange(20))) for i in range(300)]
    got = {x["rep"]: x["rank"] for x in analytics.state_ranks(spark.createDataFrame(rows, "rep long, approx double")).collect()}
    assert got == {rep: k for k, (_, rep) in enumerate(sorted((a, rep) for rep, a in rows))}
