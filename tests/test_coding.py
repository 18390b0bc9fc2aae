"""What one pass over texts draws, and hits counted in batches, against brute force."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paretide.operators import coding, cost, kmer, motifs
from paretide.plans import derived, table_queries

SF = "/root/testdata/sf0.001"


def some_texts(n=300):
    r = random.Random(11)
    odd = [None, "", "xyz", "é" * 40, "ATG", "ATGTAA", "TAAATGTGA", "ATGATAA", "ATG" + "CCC" * 90 + "TAG", "ẗATGAAATGA", "AT GŉG-CtaA"]
    return odd + ["".join(r.choice("ACGTacgt TNé\n") for _ in range(r.randrange(160))) for _ in range(n)]


def letters(text):
    return re.sub("[^ACGT]", "", "".join(c.upper() if c in "acgt" else c for c in text or ""))


def region(text):
    s = letters(text)
    s = s[s.index("ATG") :] if "ATG" in s else ""
    i = next((i for i in range(0, len(s) - 2, 3) if s[i : i + 3] in cost.STOPS), None)
    return None if i is None else s[: i + 3]


def rows(texts):
    return [(i, random.Random(i).choice(["x", "y", None]), t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("at_a_time", [7, 1 << 20])
def test_regions_and_counts_of_texts_equal_brute_force(monkeypatch, at_a_time):
    data = rows(some_texts())
    monkeypatch.setattr(kmer, "LETTERS", at_a_time)
    whole = pa.RecordBatch.from_arrays([pa.array([x[i] for x in data]) for i in range(3)], names=["id", "key", "text"])
    parts = [whole.slice(0, 100), whole.slice(100, 0), whole.slice(100)]
    found = [x for b in coding._regions(iter(parts), "text") for x in b.to_pylist()]
    want = [{"id": i, "key": k, "seq": region(t)} for i, k, t in data if region(t)]
    assert found == want and len(want) > 50
    for bins in (1 << 22, 0):
        monkeypatch.setattr(kmer, "BINS", bins)
        got = collections.Counter()
        for b in coding._drawn(iter([x.select(["key", "text"]) for x in parts])):
            for x in b.to_pylist():
                got[x["what"], x["key"], x["pos"], x["code"]] += x["n"]
        expected = collections.Counter(("kmer", None, 0, coding._code(s[i : i + 3])) for s in (letters(t) for _, _, t in data) for i in range(len(s) - 2))
        expected.update(("region", x["key"], 0, 0) for x in want)
        expected.update(("letter", x["key"], i, "ACGT".index(c)) for x in want for i, c in enumerate(x["seq"]))
        assert got == expected


@pytest.mark.parametrize("at_a_time", [1, 7, 1 << 20])
@pytest.mark.parametrize("others", ["", "N"])
def test_windows_hold_inside_their_own_sequence(monkeypatch, at_a_time, others):
    monkeypatch.setattr(kmer, "LETTERS", at_a_time)
    r = random.Random(4)
    seqs = ["", "A", *("".join(r.choice("ACGT" + others) for _ in range(r.randrange(14))) for _ in range(60)), "", "T" * 40, ""]
    whole, place = "".join(seqs), kmer.places(pa.array(seqs))
    for m in (1, 2, 3, 4, 5, 8, 9, 17):
        want = [(i, j, coding._code(s[j : j + m])) for i, s in enumerate(seqs) for j in range(len(s) - m + 1) if "N" not in s[j : j + m]]
        parts = list(kmer.stretches(*place, m))
        assert [a for a, _, _ in parts] == list(range(0, len(whole) - m + 1, at_a_time))
        assert [int(c) for _, code, holds in parts for c in code[holds]] == [c for _, _, c in want]
        assert [tuple(map(int, x)) for part in kmer.codes(*place, m) for x in zip(*part, strict=True)] == want


def test_regions_take_few_bytes_a_letter():
    n = 1 << 20
    letters, at = np.random.default_rng(1).integers(0, 4, n, dtype=np.uint8), np.r_[np.arange(0, n, 600), n]
    tally = kmer.Tally(64)
    tracemalloc.start()
    row, _, _ = coding._found(letters, at, tally.add)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a code is one byte, and only start and stop codons have a row and a place
    assert len(row) > 1000 and tally.whole.sum() == n - 2 * (len(at) - 1) and most < 16 * n


def test_drawn_gives_targets_and_counts_without_a_row_for_a_letter(spark):
    data = rows(some_texts())
    df = spark.createDataFrame(data, "id int, key string, text string")
    out = coding.drawn(df, "text", "key")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    plain = df.withColumn("seq", kmer.dna(F.col("text")))
    for of in ((1, 2), (1, 9)):
        regions = spark.createDataFrame([(k, region(t)) for _, k, t in data if region(t)], "key string, seq string")
        same = lambda x: sorted(map(tuple, x.collect()), key=str)
        assert same(coding.consensus(out, "key", "seq", of)) == same(kmer.consensus(regions, "key", "seq", of))
    assert same(coding.triples(out)) == same(kmer.windows(plain.select("seq"), "seq", 3).groupBy("kmer").count())
    assert same(kmer.counts(df, "text", 4, "key", text=True)) == same(kmer.windows(plain.select("key", "seq"), "seq", 4).groupBy("key", "kmer").count())


def test_only_plain_letters_count(spark):
    # Spark's upper makes a T and a sign of the first; DuckDB's leaves it
    assert spark.createDataFrame([("ẗacéŉG",)], "t string").select(kmer.dna(F.col("t"))).first()[0] == "ACG"


def test_hit_totals_equal_hits(spark, monkeypatch):
    r = random.Random(2)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(some_texts(80))], "id int, text string")
    table = spark.createDataFrame([(f"m{i}", m, [float(r.randrange(-4, 5)) for _ in range(4 * m)], least) for i, (m, least) in enumerate([(3, 4.0), (3, None), (4, 6.0), (4, 9.0), (4, 99.0), (9, 5.0)])], "matrix_id string, m int, w array<double>, least double")
    plain = texts.withColumn("text", kmer.dna(F.col("text")))
    for m, strand in ((3, "double"), (4, "forward"), (4, "backward"), (9, "double"), (5, "forward")):
        each = motifs.hits(plain, "text", table, m, strand).groupBy("id", "matrix_id").agg(F.count("*"), F.max("score"), F.min("start"))
        want = sorted(map(tuple, each.collect()))
        for bins in (1 << 22, 1):
            monkeypatch.setattr(kmer, "BINS", bins)
            got = motifs.hit_totals(texts, "text", table, m, strand, text=True)
            assert sorted(map(tuple, got.collect())) == want
            assert m > 8 or "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        assert bool(want) == (m != 5)


def test_a_long_sequence_with_hits_in_several_pieces_is_one_row(monkeypatch):
    monkeypatch.setattr(kmer, "LETTERS", 5)
    w = np.array([[1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["CAAC" * 20, "AA"])], names=["id", "text"])
    got = [x for b in motifs._totals(iter([batch]), "text", pa.array(["m"]), w, np.array([2.0]), 2, "forward", True) for x in b.to_pylist()]
    assert got == [{"id": 1, "matrix_id": "m", "n_hits": 20, "best": 2.0, "first_start": 2}, {"id": 2, "matrix_id": "m", "n_hits": 1, "best": 2.0, "first_start": 1}]


@pytest.mark.parametrize("name", ["codons", "exact"])
def test_a_design_draws_from_one_reading_of_the_texts(spark, monkeypatch, name):
    read, table = [], derived.table
    monkeypatch.setattr(derived, "table", lambda s, d, t: (read.append(t), table(s, d, t))[1])
    targets, scores, _ = table_queries._drawn(spark, SF, table_queries._SHORT, name)
    assert read == ["documents"] and targets.count() and scores.count() == 64
