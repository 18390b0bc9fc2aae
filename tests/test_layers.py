"""Designs with stored back-pointers against brute force, costs of a table of targets, coloured machines of eight letters."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paretide.operators import cost, kmer, layers, machines

USAGE = {c: 0.25 * (1 + i % 5) for i, c in enumerate(sorted(cost.AMINO_ACIDS))}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def usage(spark):
    return cost.usage_map(spark.createDataFrame(list(USAGE.items()), "codon string, cost double"))


def targets(spark, marked):
    return cost.targets(spark.createDataFrame(marked, "job string, seq string"))


def score(v):
    return float((v * 5) % 7 - 3)


def brute(m, marked, known):
    table = {(i, x, s): c for i, x, s, c in cost.cost_table(marked, known)}
    n = max(i for i, _, _ in table)
    points = {}
    for letters in itertools.product("ACGT", repeat=n):
        s = "".join(letters)
        f = 0.0
        for i in range(n):
            f -= table[i + 1, ("AA" + s)[i : i + 2], s[i]]
        if f == -np.inf:
            continue
        codes = ["ACGT".index(x) for x in s]
        b = sum(score(sum(codes[i - m + j] * 4 ** (m - 1 - j) for j in range(m))) for i in range(m, n + 1))
        points.setdefault((f, b), []).append(s)
    return [(f, b, s) for (f, b), ss in points.items() if not any(f2 >= f and b2 <= b and (f2, b2) != (f, b) for f2, b2 in points) for s in ss]


def machine(spark, m):
    return kmer.transitions(spark, m), spark.range(4**m).select(F.col("id").alias("v"), ((F.col("id") * 5) % 7 - 3).cast("double").alias("score"))


@pytest.mark.parametrize(("name", "block"), [("exact", 1), ("exact", 4), ("codons", 3), ("codons", 1)])
def test_designs_of_targets_of_several_lengths_equal_brute_force(spark, name, block):
    marked = [("a", "*ATGTAA"), ("b", "A*ATGTGA"), ("c", "GATTA"), ("d", "G")]
    params = {"usage": usage(spark)} if name == "codons" else {}
    known = USAGE if name == "codons" else None
    made = layers.design(targets(spark, marked), *machine(spark, 2), 2, lambda at: cost.COSTS[name](at, **params), block=block)
    got = rows(layers.sequences(made, layers.front(made)))
    assert got == sorted((job, f, b, s) for job, m in marked for f, b, s in brute(2, m, known))
    assert made.numbers[-1] == made.last == 7
    if name == "codons" and block == 1:
        sizes = {(r["job"], r["i"], r["v"]): (r["size"], r["pruned"]) for r in layers.sizes(made).collect()}
        assert len(sizes) == sum(len(m.replace("*", "")) for _, m in marked) * 16
        assert sum(p for _, p in sizes.values()) > 0
        assert sum(n for (job, i, _), (n, _) in sizes.items() if job == "c" and i == 5) == made.points(7).filter("job = 'c'").count()


def test_bounds_on_points_and_ties(spark):
    marked = [("x", "".join(random.Random(4).choice("ACGT") for _ in range(64)))]
    exact = cost.COSTS["exact"]
    free = layers.design(targets(spark, marked), *machine(spark, 2), 2, exact, max_ties=1)
    best = rows(layers.sequences(free, layers.front(free), 1))
    assert len(best) == len({r[:3] for r in best})
    for job, f, b, s in best[:10]:
        assert (len(s), f) == (64, -sum(x != y for x, y in zip(s, marked[0][1], strict=True)))
        assert b == sum(score(4 * "ACGT".index(s[i - 1]) + "ACGT".index(s[i])) for i in range(1, 64))
    few = layers.design(targets(spark, marked), *machine(spark, 2), 2, exact, k=5, max_ties=1)
    assert few.points(64).groupBy("v").count().agg(F.max("count")).first()[0] <= 5
    assert layers.front(few, k=3).select("f", "b").distinct().count() <= 3
    for _, f, b, s in layers.sequences(few, layers.front(few, k=3), 1).collect():
        assert any(f <= f2 and b >= b2 for _, f2, b2, _ in best) and len(s) == 64


def test_no_targets_and_empty_targets(spark):
    for marked in ([], [("e", "")]):
        made = layers.design(targets(spark, marked) if marked else targets(spark, [("e", "A")]).limit(0), *machine(spark, 2), 2, cost.COSTS["exact"])
        assert layers.sequences(made, layers.front(made)).count() == 0


def test_costs_of_targets_equal_the_table_of_each(spark):
    marked = [("a", "C*ATGTGTTAAG"), ("b", "ACGT"), ("c", "")]
    for name, known, params in (("exact", None, {}), ("codons", USAGE, {"usage": usage(spark)})):
        got = rows(cost.target_costs(targets(spark, marked), name, **params).select("job", "i", "ctx", "sigma", "cost"))
        # the first two letters have no codon before them, so their contexts are all the same
        assert got == sorted((job, *row) for job, m in marked if m for row in cost.cost_table(m, known))
    with pytest.raises(Exception, match="no stop codon"):
        targets(spark, [("x", "*ATGAAA")]).collect()


def test_coloured_machine_of_eight_letters(spark):
    r = random.Random(8)
    states = spark.createDataFrame([(v, r.randrange(3) if v % 5 else 0) for v in range(4**6)], "v long, color int")
    classes = machines.colored_classes(states, 6, 2)
    assert machines.violations(kmer.transitions(spark, 6), classes, states, 2).count() == 0
    long = spark.range(4**8).select(F.col("id").alias("v"), F.when(F.col("id") % 997 == 0, 1).otherwise(0).alias("color"))
    classes = machines.colored_classes(long, 8, 2)
    assert classes.count() == 4**8
    assert machines.violations(kmer.transitions(spark, 8), classes, long, 2).count() == 0
