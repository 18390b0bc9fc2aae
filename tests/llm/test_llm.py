"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats, extra columns."""

import collections
import hashlib
import html
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paretide.llm import bpe, components, hash_forest, html_extract, jaccard_join, mixing, quality, sharding, substring_dedup, suffix_dedup, toxicity
from paretide.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string"


def corpus(seed=0, n=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["Ünï", "日本"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, base = text(60), text(120)
    out = [None, "", " \n\t ", "one", "one two three", "one two three", base, base, base + " tail", text(3000)]
    for i in range(n):
        t = text(r.randint(1, 150))
        if i % 3 == 0:
            t = t + " " + passage + " " + text(20)
        if i % 5 == 0:
            near = base.split()
            near[r.randrange(len(near))] = "changed"
            t = " ".join(near)
        out.append(t.replace("a ", "a\n", 3))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", "s", 1, "x", "y") for i, t in enumerate(corpus())]
    return spark.createDataFrame([*rows, (None, "no id at all", None, None, None, None, None)], DOCS)


def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.filter("doc_id is not null").collect()]


@pytest.mark.parametrize("hot", [2_000_000, 2])
def test_suffix_dedup_equals_brute_force(docs, hot):
    width = 60
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(docs, width, hot).collect()}
    n = collections.Counter()
    for _, t in [*texts(docs), (0, "no id at all")]:
        b = t.encode()
        n.update(b[i : i + width] for i in range(len(b) - width + 1))
    for i, t in texts(docs):
        b, gone = t.encode(), [False] * len(t.encode())
        for k in range(len(b) - width + 1):
            if n[b[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        g = got[i]
        assert (g["n_bytes"], g["n_removed"], bytes(g["kept"])) == (len(b), sum(gone), bytes(x for x, y in zip(b, gone, strict=True) if not y))
        assert g["n_spans"] == sum(y and (k == 0 or not gone[k - 1]) for k, y in enumerate(gone))
    assert len(got) == docs.count()
    assert suffix_dedup.deduplicated(docs, width).columns == docs.columns
    assert suffix_dedup.op3(docs.limit(0)).count() == 0


def test_long_documents_are_cut_into_overlapping_pieces(spark, monkeypatch):
    from paretide.llm import hashing, repeats

    r = random.Random(5)
    piece = "".join(r.choice("abcd ") for _ in range(90))
    data = ("".join(r.choice("abcd ") for _ in range(500)) + piece + "".join(r.choice("abcd ") for _ in range(400)) + piece).encode()
    raw, offsets = np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)])
    for words in (False, True):
        of = repeats.Windows(5 if words else 40, 2 if words else 8, words)
        seen = []
        for block in (1 << 20, 128):
            monkeypatch.setattr(hashing, "BLOCK", block)
            monkeypatch.setattr(repeats, "BLOCK", block)
            found = []
            for _, x, rows, cut in repeats.symbols(raw, offsets, of):
                _, first, size, _, m, _ = repeats.runs_of(x, rows, of.width, of.gram)
                found += [(int(a + cut + j), int(k)) for a, n, k in zip(first, size, m, strict=True) for j in range(n)]
            seen.append(sorted(found))
        assert seen[0] == seen[1]


@pytest.mark.parametrize("hot", [2_000_000, 2])
def test_substring_dedup_equals_brute_force(docs, hot):
    got = {r["doc_id"]: r for r in substring_dedup.dedup(docs, 13, hot).collect()}
    first = {}
    for i, t in sorted(texts(docs)):
        w = t.encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in texts(docs):
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        assert (got[i]["n_words"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y))
    assert substring_dedup.op5(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def repeated(spark):
    """Rows that share a doc_id, or have none, with equal, different, null, blank and long texts; -1 is a doc_id too."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    a, b, c = text(40), text(40), text(40)
    rows = [(1, f"{text(60)} {a} {text(9)}"), (1, "short text"), (2, f"{a} {text(5)}"), (2, f"{text(5)} {b} {text(3)} {b}"), (2, None), (3, b), (3, b), (3, ""), (None, c), (None, c), (None, f"{text(3)} {c}"), (None, None), (4, f"{c} {text(300)} {a}"), (5, "alone"), (5, "alone"), (-1, f"{text(4)} {a}"), (0, f"{a} {text(4)}"), (-7, text(30))]
    return spark.createDataFrame([(i, t, 1, "s", "r", 2, 3) for i, t in rows], "doc_id long, text string, k int, spans string, `row` string, t int, N_BYTES int")


@pytest.mark.parametrize("hot", [2_000_000, 2])
def test_suffix_dedup_with_repeated_and_missing_ids(repeated, hot):
    width, rows = 60, [(r["doc_id"], (r["text"] or "").encode()) for r in repeated.collect()]
    n = collections.Counter(b[i : i + width] for _, b in rows for i in range(len(b) - width + 1))
    want = []
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if n[b[k : k + width]] > 1:
                gone[k : k + width] = [True] * width
        want.append((str(i), len(b), sum(gone), sum(y and (k == 0 or not gone[k - 1]) for k, y in enumerate(gone)), bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    got = suffix_dedup.dedup(repeated, width, hot)
    assert got.columns == ["doc_id", "k", "spans", "row", "t", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == sorted(want)
    again = suffix_dedup.deduplicated(repeated, width)
    assert again.columns == repeated.columns
    assert sorted(r["text"].encode() for r in again.collect()) == sorted(x[-1] for x in want)


@pytest.mark.parametrize("hot", [2_000_000, 2])
def test_substring_dedup_with_repeated_and_missing_ids(repeated, hot):
    rows = [(-(2**63) if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode().split()) for r in repeated.collect()]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want.append((i, len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y)))
    got = substring_dedup.dedup(repeated, 13, hot).collect()
    assert sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in got) == sorted(want)


def test_radix_passes_compare_the_bytes_themselves(monkeypatch):
    """With a fingerprint that is the same for every digit the passes still tell windows apart."""
    from paretide.llm import repeats

    r = np.random.default_rng(0)
    runs, width = 40, 60
    x = r.integers(97, 100, (runs, width + 4)).astype(np.uint8)
    x[20:] = x[:20]
    x[25:, 30] = 120
    x[39, 0] = 121
    j = np.tile(np.arange(5), runs)
    run = np.repeat(np.arange(runs), 5)
    ones = np.ones(runs, dtype=np.int64)
    g = repeats.Group(x.ravel(), ones, np.arange(runs), ones, ones, run, j, run * (width + 4) + j, np.tile(np.arange(5)[::-1], runs))
    n = collections.Counter((int(g.back[i]), x.ravel()[p : p + width].tobytes()) for i, p in enumerate(g.pos))
    want = [n[int(g.back[i]), x.ravel()[p : p + width].tobytes()] > 1 for i, p in enumerate(g.pos)]
    of = repeats.Windows(width, 10, False)
    for digit in (40, 7, 3):
        assert suffix_dedup.radix_passes(g, of, digit)[1].tolist() == want
    monkeypatch.setattr(suffix_dedup, "span", lambda sums, a, b: np.zeros(len(a), dtype=np.uint64))
    assert suffix_dedup.radix_passes(g, of)[1].tolist() == want


def test_jaccard_join_equals_brute_force(docs):
    got = {r["doc_id"]: r for r in jaccard_join.op8(docs).collect()}
    sets = {}
    for i, t in texts(docs):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in sets} == {i: (len(s), root[i]) for i, s in sets.items()}
    assert got[None]["component_id"] is None
    assert jaccard_join.op8(docs.limit(0)).count() == 0


def test_jaccard_join_with_repeated_and_missing_ids(spark):
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c = text(60), text(60), text(400)
    rows = [(5, a), (5, b), (1, f"{a} end"), (2, f"{b} end"), (7, c), (7, c), (7, None), (6, f"{c} x"), (None, a), (None, None), (8, ""), (8, ""), (9, "one two"), (3, "one two"), (9, "ONE two"), (4, text(50_000))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k int, component_id string")
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(len(rows)):
            if sets[x] and sets[y] and None not in (rows[x][0], rows[y][0]) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                root = [root[x] if v == root[y] else v for v in root]
    least = {v: min((rows[j][0] for j in range(len(rows)) if root[j] == v and rows[j][0] is not None), default=None) for v in root}
    want = sorted(str((i, len(s), least[v])) for (i, _), s, v in zip(rows, sets, root, strict=True))
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in jaccard_join.op8(docs).collect()) == want


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100 + r.randrange(20), 100 + r.randrange(20)) for _ in range(15)]
    edges = [(a, b) for a, b in edges if a != b]
    with pytest.raises(RuntimeError, match="converge"):
        components.components(spark.createDataFrame(edges, "a long, b long"), rounds=1)
    root = {x: x for e in edges for x in e}
    for a, b in edges * 40:
        root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def test_bpe_round_trip_and_safe_cuts(docs):
    enc = bpe.encoding(*tokenizer())
    rows = {r["doc_id"]: r for r in bpe.op6(docs, *tokenizer()).collect()}
    for i, t in texts(docs):
        ids = enc.encode_ordinary(t)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    r = random.Random(4)
    for _ in range(200):
        t = "".join(r.choice(["a", "B", " ", "  ", "\n", "'s", "1", "é", "日", "!", " ", "\t"]) for _ in range(80))
        assert "".join(bpe.pieces(t, 7)) == t
        assert bpe.encode(t, enc, 7) == enc.encode_ordinary(t)
    back = bpe.decoded(bpe.encoded(docs, *tokenizer()), *tokenizer())
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back.filter("doc_id is not null").collect()} == dict(texts(docs))


def test_quality_counts_equal_brute_force(spark, docs):
    odd = spark.createDataFrame([(9000, "Ab#c *** <b> a|b 100% & $5 > x\n" * 3, "en", "s", 1, "x", "y"), (9000, "again", "en", "s", 1, "x", "y"), (9003, "é" * 70_000 + " # " + "w " * 30_000, "en", "s", 1, "x", "y")], DOCS)
    docs = docs.union(odd)
    got = collections.defaultdict(list)
    for r in quality.op7(docs).collect():
        got[r["doc_id"]].append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
        assert not (r["base_failed"] and r["kept"])
    want = collections.defaultdict(list)
    for i, t in texts(docs):
        w = [x.decode() for x in t.encode().split()]
        n = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) for j in range(3) if n[tuple(w[k : k + 3])] > 1}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want[i].append((len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)))
    assert {i: sorted(x) for i, x in got.items() if i is not None} == {i: sorted(x) for i, x in want.items()}
    assert quality.op7(docs.limit(0)).count() == 0


def test_quality_estimation_equals_an_independent_one():
    r = np.random.default_rng(0)
    votes = r.choice([-1, 0, 1], p=[0.05, 0.1, 0.85], size=(400, 8))
    votes[:60, 1] = votes[:60, 2] = -1
    counts = collections.Counter(map(tuple, votes.tolist()))
    shares, chances = quality.fit(sorted(counts.items()), rounds=40)
    hot = np.stack([votes == x for x in (-1, 0, 1)], axis=2).astype(float)
    own = list(quality.KINDS.values())
    w0 = np.array([quality._GOOD] + [(1 - quality._GOOD) / 4] * 4)
    prior = np.array([[quality._OWN if j in k else quality._OTHER for j in range(8)] for k in own])
    pull = 400 * w0[:, None] * np.array([[quality._ANCHORED if c == 0 or j in k else quality._LOOSE for j in range(8)] for c, k in enumerate(own)])
    w, p = w0, prior
    for _ in range(40):
        x = np.log(w) + np.einsum("njv,cjv->nc", hot, np.log(p))
        member = np.exp(x - np.logaddexp.reduce(x, axis=1)[:, None])
        w = member.sum(axis=0) + quality._LOOSE * 400 * w0
        w = w / w.sum()
        n = np.einsum("nc,njv->cjv", member, hot) + pull[:, :, None] * prior
        p = n / n.sum(axis=2, keepdims=True)
    assert np.allclose(shares, w, atol=1e-6)
    assert np.allclose(chances, p, atol=1e-6)
    assert abs(p[0, 1, 0] - prior[0, 1, 0]) > 1e-4  # accuracies are estimated, not the anchors


def test_quality_posterior_and_single_votes_decide(spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts"]
    good, symbols, repeats = (100, 500, 0, 0, 0, 10, 10, 0), (100, 500, 150, 0, 0, 10, 10, 0), (100, 500, 0, 2, 49, 10, 10, 0)
    rows = [("good", *good)] * 800 + [("symbols", *symbols)] * 60 + [("again", 100, 500, 0, 2, 90, 10, 10, 0)] * 140
    rows += [("one against", 100, 500, 0, 5, 0, 10, 10, 0)] * 2 + [("abstains", *repeats)]
    feats = spark.createDataFrame([(*r, "x", "y") for r in rows], ["doc", *names, "kept", "_votes"])
    votes = {r["doc"]: [r[f"v{j}"] for j in range(8)] for r in feats.select("doc", *[v.alias(f"v{j}") for j, v in enumerate(quality.votes())]).distinct().collect()}
    assert votes["one against"].count(-1) == 1
    got = quality.judged(feats)
    assert [c for c in got.columns if c.startswith("_")] == ["_votes"]
    kept = {r["doc"]: (r["base_failed"], r["kept"]) for r in got.distinct().collect()}
    assert kept == {"good": (False, True), "symbols": (False, False), "again": (True, False), "one against": (False, True), "abstains": (False, False)}
    model = quality.fit(sorted(collections.Counter(tuple(votes[r[0]]) for r in rows).items()))
    assert quality.memberships(model, (1, 0, 0, 0, 1, 1, 1, 1))[0] < 0.5  # no vote against, and rejected


def test_quality_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4, "k")], "doc_id long, text string, _text int, _words int, N_Words int, posterior int, `odd.name` string")
    got = quality.judged(quality.features(docs))
    assert {"_text", "_words", "odd.name", "n_words", "posterior"} <= set(got.columns)
    assert (got.first()["_text"], got.first()["n_words"], got.first()["odd.name"]) == (1, 3, "k")


def test_toxicity_segments_and_held_out_labels(spark):
    assert toxicity.segments([(2, 3.0), (3, 2.0), (50, 4.0)], 60) == [(2, 4, 5.0), (50, 51, pytest.approx(4.0))]
    r = random.Random(0)
    word = lambda: "".join(r.choice("aeioubdgk") for _ in range(5))
    rows, labels = [], []
    for i in range(900):
        t = [word() for _ in range(60)]
        if i % 6 == 0:
            for _ in range(4):
                t.insert(r.randrange(60), "vile" + r.choice("xyz"))
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    got = toxicity.op1(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    known = dict(labels)
    assert len(got) == 902
    assert {r["held_out"] for r in got} == {True, False}
    assert all(r["predicted"] == known.get(r["doc_id"], 0) for r in got)
    none = toxicity.op1(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in none.collect()} == {0.0}


def test_toxicity_segments_equal_brute_force():
    """The segments are those that recursion on the best sub-sequence gives (the shortest, then the first of equals)."""
    def best(x, lo, hi):
        found = [(-sum(x[a:b]), b - a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
        top = min(found, default=(0, 0, 0, 0))
        if top[0] >= 0:
            return []
        return [*best(x, lo, top[2]), (top[2], top[3]), *best(x, top[3], hi)]

    r = random.Random(2)
    for _ in range(60):
        x = [r.randint(-5, 5) + r.random() for _ in range(r.randint(0, 18))]
        got = toxicity.segments(list(enumerate(x)), len(x))
        assert [(a, b) for a, b, _ in got] == best(x, 0, len(x))
        assert [s for *_, s in got] == pytest.approx([sum(x[a:b]) for a, b, _ in got])


def test_toxicity_weights_equal_brute_force(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(["aa", "bb", "cc", "dd"]) for _ in range(6)] + (["vile"] if i % 4 == 0 and r.random() < 0.8 else [])
        rows.append((i, f"{i}z " + " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    n = [collections.Counter(), collections.Counter()]
    for (i, t), (_, y) in zip(rows, labels, strict=True):
        if zlib.crc32(str(i).encode()) % 3 != 1:
            n[y].update(set(t.split()))
    total = [sum(c.values()) for c in n]
    for w in ("aa", "bb", "vile"):
        a = toxicity.PRIOR_TOKENS * (n[0][w] + n[1][w]) / sum(total)
        x, y = n[1][w] + a, n[0][w] + a
        odds = np.log(x / (total[1] + toxicity.PRIOR_TOKENS - x)) - np.log(y / (total[0] + toxicity.PRIOR_TOKENS - y))
        z = odds / np.sqrt(1 / x + 1 / y)
        assert model.weight.get(w) == (pytest.approx(odds) if abs(z) >= toxicity.Z else None)
    assert model.weight["vile"] > 0


def test_toxicity_long_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, "x" * 500_000), (2, "a " * 200_000), (2, None), (None, ""), (3, "bad bad"), (3, "bad bad")], "doc_id long, text string")
    got = toxicity.score(docs.withColumn("score", F.lit("clash")), toxicity.Model({"bad": 5.0}, 1.0, 0.1, (-2.0, 3.0))).collect()
    assert len(got) == 6
    assert {r["predicted"] for r in got if r["doc_id"] == 3} == {1}
    assert {r["predicted"] for r in got if r["doc_id"] != 3} == {0}
    assert toxicity.op1(docs.limit(0), docs.select("doc_id", F.lit(1).alias("toxic"))).count() == 0


def test_toxicity_term_counts_at_any_size_of_the_corpus(spark):
    r = random.Random(6)
    rows, labels, trained = [], [], []
    for i in range(8400):
        t = ["".join(r.choice("aeioubdgk") for _ in range(2)) for _ in range(9)] + [f"{i}"]
        toxic = i % 2
        if toxic and zlib.crc32(str(i).encode()) % 3 != 1:  # not held out
            trained.append("zzz" if len(trained) < 26 else "vile")
            t.append(trained[-1])
        rows.append((i, " ".join(t)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert 26 < 0.01 * len(trained)
    assert model.weight["zzz"] > 0
    assert toxicity.evidence("zzz zzz", model, toxicity._Scores(model.weight))[0] > 0


def test_html_omitted_end_tags():
    texts = lambda page: [t for t, _, _ in html_extract.blocks(page)]
    assert texts("<html><head><title>T</title><meta charset=u><body><p>a<p>b</html>") == ["a", "b"]
    assert texts("<html><head><title>T</title><link rel=x><article><p>a</article></html>") == ["a"]
    assert texts("<html><head><title>T<body><div>a</div></body></html>") == ["a"]
    assert texts("<head><script>x</script> text <p>a") == ["text", "a"]
    assert texts("<head><noscript><style>x</style></noscript><title>T</title></head><body><p>a") == ["a"]
    for tag in ("select", "button", "noscript", "iframe", "textarea", "svg", "object"):
        assert texts(f"<body><{tag} class=x>no<div>a</div><p>b</body>") == ["a", "b"]
        assert texts(f"<body><{tag} class=x>no<div>no</div></{tag}><p>b</body>") == ["b"]
    assert texts("<select><option>x<option>y</select><p>a") == ["a"]
    assert texts("<svg><svg><g>x</g></svg><text>y</text></svg><p>a") == ["a"]


def test_html_blocks_and_labels():
    page = "<p>a &amp; b<br>c<p>d <a href='x'>e</a><script>no</script><!-- no --><div class='ad'>f&nbsp;&#65;</div>"
    assert [(t, n) for t, _, n in html_extract.blocks(page)] == [("a & b c", 0), ("d e", 1), ("f A", 0)]
    assert html_extract.blocks("") == []
    net = html_extract.trained()
    wrong = total = 0
    for found, label in html_extract.training_pages(60, 12345):
        x, mask = html_extract._padded(html_extract.vectors([found]), [len(found)])
        wrong += int(((net(x, mask)[:, 0] > 0.5) != np.array(label)).sum())
        total += len(label)
    assert wrong < 0.02 * total


#: Hand-written pages in layouts that training doesn't generate, with the blocks of their main text.
PAGES = {
    "news": ('<body><div class="cookie-banner"><p>We use cookies to improve your experience on this site.</p><button>Accept</button></div><header><a href="/">Daily News</a></header><nav><a href="/w">World</a> <a href="/s">Sport</a></nav> <section class="story"><div class="story-body"><h1>Council approves new bridge over the river</h1><p>The city council voted on Tuesday to build a second bridge, after a debate of four hours.</p><div class="advert"><p>Buy new shoes today, only here!</p></div><p>Work is due to start in the spring, the mayor said, and will take about two years.</p><blockquote><p>It is the largest project of the decade, and it will change the town.</p></blockquote><p>Shops near the site will get help from a fund of the region.</p></div></section> <aside class="related"><h3>Related stories</h3><ul><li><a href="/1">Bridge closed for repairs</a></li><li><a href="/2">Mayor seeks second term</a></li></ul></aside><footer><ul><li><a href="/t">Terms</a></li></ul><p>Copyright Daily News</p></footer></body>', ['Council approves new bridge over the river', 'The city council voted on Tuesday to build a second bridge, after a debate of four hours.', 'Work is due to start in the spring, the mayor said, and will take about two years.', 'It is the largest project of the decade, and it will change the town.', 'Shops near the site will get help from a fund of the region.']),
    "docs": ('<body><div class="topbar"><a href="/">Docs</a><form class="search"><label>Search</label><input name=q></form></div><div class="sidebar"><ul class="toc"><li><a href="#1">Install</a></li><li><a href="#2">Usage</a></li></ul></div><div class="content" role="main"><h1>Install</h1><p>Download the archive for your system, unpack it, and put the program on your path.</p><h2>Usage</h2><p>Run the program with a file name, and it prints a summary of the file.</p><pre>tool file.txt</pre><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>verbose</td><td>print more about each step</td></tr></table></div><div class="footer">Powered by a generator</div></body>', ['Install', 'Download the archive for your system, unpack it, and put the program on your path.', 'Usage', 'Run the program with a file name, and it prints a summary of the file.', 'tool file.txt', 'Option', 'Meaning', 'verbose', 'print more about each step']),
    "bare": ('<html><body><div><a href=/>Start</a> <a href=/m>Map</a></div><h1>On rivers</h1><p>A river begins at a spring, where water comes out of the ground after rain has sunk in.<p>On its way it takes up smaller streams, and becomes wide and slow.<p>In the end it reaches the sea, and the water rises again as clouds.<hr><div><p>Contact | Imprint</div></body></html>', ['On rivers', 'A river begins at a spring, where water comes out of the ground after rain has sunk in.', 'On its way it takes up smaller streams, and becomes wide and slow.', 'In the end it reaches the sea, and the water rises again as clouds.']),
    "blog": ('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Fixing a bicycle</title><style>p{color:red}</style></head> <body class="single single-post"><div id="page" class="site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">My Blog</a></p></div> <nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav></header> <div id="content" class="site-content"><main id="main"><article id="post-12" class="post type-post"><h1 class="entry-title">Fixing a bicycle</h1> <div class="entry-content"><p>Last week the chain of my old bicycle broke on the way to work, and I had to walk for an hour.</p><p>Here is how I repaired it at home with a few simple tools &amp; some patience.</p><ul><li>A chain tool and two spare links.</li><li>Some oil, and a cloth to clean it.</li></ul></div></article> <div id="comments" class="comments-area"><h2 class="comments-title">2 comments</h2><ol class="comment-list"><li class="comment"><p>Great post, this helped me a lot with my own bike, thank you.</p></li></ol></div></main> <aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/a">How to bake bread</a></li></ul></section></aside></div> <footer id="colophon" class="site-footer"><p>© 2021 My Blog. All rights reserved.</p></footer></div><script>var x = "<p>no</p>";</script></body></html>', ['Fixing a bicycle', 'Last week the chain of my old bicycle broke on the way to work, and I had to walk for an hour.', 'Here is how I repaired it at home with a few simple tools & some patience.', 'A chain tool and two spare links.', 'Some oil, and a cloth to clean it.']),
}


def test_html_pages_written_by_hand():
    net = html_extract.trained()
    got = {k: html_extract.main_texts([page], net)[0] for k, (page, _) in PAGES.items()}
    assert {k: got[k] for k in ("news", "docs", "bare")} == {k: " ".join(PAGES[k][1]) for k in ("news", "docs", "bare")}
    assert got["blog"].startswith(" ".join(PAGES["blog"][1]))
    assert not any(x in got["blog"] for x in ("Great post", "My Blog", "Recent", "Home", "bread"))


def test_html_deep_pages_keep_their_article():
    body = "Some long words here, and more. " * 20
    for n in (0, 15, 25, 60, 400):
        page = "<body><nav><ul><li><a href=x>Home</a></li></ul></nav><article class='post'>" + "<div>" * n + f"<p>{body}</p>" + "</div>" * n + "</article><footer>© 2020</footer></body>"
        assert html_extract.main_texts([page], html_extract.trained()) == [body.strip()]


def test_html_parser_is_linear():
    for junk in ("<a ", "<div>x", "</b", "<i><p>", "<!--", "<a '\">", "<select><svg><div>", "<script></script ", "<svg><div>"):
        times = []
        for n in (2_000, 16_000):
            began = time.perf_counter()
            html_extract.blocks(junk * n + "<i>" * n + "</u>" * n + "<div></div>" * n)
            times.append(time.perf_counter() - began)
        assert times[1] < 40 * times[0] + 0.2  # eight times the text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_html_equals_a_plain_reading_of_the_test_pages():
    """In these tables the main text is the article element, without nested boxes: a few substitutions read it."""
    import duckdb

    pages = [r[0] or "" for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()]
    want = []
    for page in pages:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
        x = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", inner[1] if inner else "", flags=re.S)
        x = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h\d|div|ul|li|br)\b[^>]*>", " ", x))
        want.append(" ".join(html.unescape(x).split()))
    assert html_extract.main_texts(pages, html_extract.trained()) == want


def test_html_query_defines_nulls(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<nav><a href=x>menu</a></nav><article><h1>Title</h1><p>" + "Some long words here. " * 20 + "</p></article>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.op2(rows).collect()}
    assert (got[1]["text"], got[2]["n_chars"]) == ("", 0)
    assert got[3]["text"] == "Title " + ("Some long words here. " * 20).strip()


def test_nearest_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((1500, 12))
    x[7] = x[100]
    x[8] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5100, [0.0] * 12), (5200, [float("nan")] * 12), (5300, [None] * 12), (5400, [1.0]), (100, x[100].tolist())]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>")
    hits = 0
    got = collections.defaultdict(list)
    for row in hash_forest.search(table, leaf_bits=8, candidates=20_000).collect():
        got[row["query_id"]].append((row["rank"], row["vec_id"], row["score"]))
    assert sorted(got) == list(range(0, 1500, 100))
    for q in got:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [int(i) for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [k for k, *_ in mine] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(want))
    assert hits >= 0.9 * 150
    assert [v for _, v, _ in sorted(got[100])][:2] == [7, 8]
    assert hash_forest.search(table.limit(0)).count() == 0


@pytest.mark.parametrize("leaf_bits", [6, 4])
def test_nearest_neighbours_keep_their_recall_with_many_buckets(spark, leaf_bits):
    """64 and 256 buckets a tree."""
    x = np.random.default_rng(3).standard_normal((4000, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for row in hash_forest.search(table, query_step=40, candidates=500, leaf_bits=leaf_bits).collect():
        got[row["query_id"]][row["vec_id"]] = row["score"]
    hits = 0
    for q in range(0, 4000, 40):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert len(got[q]) == 10
        assert all(s == pytest.approx(d[v], abs=1e-12) for v, s in got[q].items())
        hits += len(set(got[q]) & set(np.argsort(d)[1:11].tolist()))
    assert hits >= 0.9 * 1000


def test_mixing_meets_targets(spark):
    r = random.Random(0)
    rows = []
    for i in range(400):
        lang = "ab"[i % 4 == 0]
        rows.append((i, " ".join(r.choice([f"{lang}{k}" for k in range(20)]) for _ in range(30)), lang))
    docs = spark.createDataFrame([*rows, (400, None, None), (None, " ", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(0, 400, 3)], "doc_id long")
    out, _, missed = mixing.mixed(docs, labels, "lang", {"a": 0.5, "b": 0.5})
    assert max(map(abs, missed.values())) < 1e-3
    sums = {x["domain"]: x["m"] for x in out.groupBy("domain").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("m")).collect()}
    assert sums["a"] == pytest.approx(6000, rel=1e-3)
    assert sums["b"] == pytest.approx(6000, rel=1e-3)
    assert out.count() == 402
    again = mixing.resampled(docs, labels)
    assert again.columns == docs.columns
    assert again.select("doc_id").distinct().count() == 402 - 1 + 1
    assert mixing.op9(docs.limit(0), labels).count() == 0


def test_mixing_takes_every_domain(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        d = i % 20
        rows.append((i, " ".join(r.choice([f"w{d}x{k}" for k in range(15)]) for _ in range(20 + d)), f"s{d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = docs.select("doc_id").filter("doc_id % 3 < 2")
    targets = {f"s{d}": 1.0 + d for d in range(20)}
    out, _, _ = mixing.mixed(docs, labels, "source", targets)
    got = out.select("_row.id", "domain", (F.col("rate") * F.col("n_tokens")).alias("m")).collect()
    assert all(x["domain"] == f"s{x['id'] % 20}" for x in got)
    whole = sum(x["m"] for x in got)
    for y, x in targets.items():
        assert sum(g["m"] for g in got if g["domain"] == y) == pytest.approx(whole * x / 210, rel=1e-2)
    with pytest.raises(ValueError, match="nowhere"):
        mixing.mixed(docs, labels, "source", {"s1": 0.5, "nowhere": 0.5})


def test_mixing_repeats_as_often_as_targets_need_and_names_may_clash(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice([f"{'ab'[i % 20 == 0]}{k}" for k in range(20)]) for _ in range(30)), "ab"[i % 20 == 0], 1, 2, 3) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rate int, n_tokens int, _row int")
    again = mixing.resampled(docs, docs.select("doc_id"), targets={"a": 0.2, "b": 0.8})  # b is wanted 76 times as often as a
    assert again.columns == docs.columns
    n = {x["lang"]: x["count"] for x in again.groupBy("lang").count().collect()}
    assert n["a"] == 570
    assert n["b"] == pytest.approx(4 * 570, rel=0.02)
    with pytest.warns(UserWarning, match="miss"):
        steps, mixing.STEPS = mixing.STEPS, 0
        try:
            mixing.mixed(docs, docs.select("doc_id"), "lang", {"a": 0.2, "b": 0.8})
        finally:
            mixing.STEPS = steps


def test_mixing_long_texts_and_empty_labels(spark):
    docs = spark.createDataFrame([(1, "a " * 300_000, "x"), (2, "b", "y"), (3, None, None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in mixing.op9(docs, docs.select("doc_id")).collect()}
    assert (out[1]["n_tokens"], out[1]["domain"], out[2]["domain"], out[3]["n_tokens"]) == (300_000, "x", "y", 0)
    none = mixing.op9(docs, docs.select("doc_id").limit(0)).collect()
    assert {(r["domain"], r["rate"]) for r in none} == {(None, 1.0)}


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i // 4, f"text {i % 7} " * (i % 50), i) for i in range(300)] + [(None, None, 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, depth int")
    sharding.write_shards(docs, str(tmp_path / "s"), 2000)
    back = spark.read.parquet(str(tmp_path / "s"))
    key = lambda df: sorted(str(tuple(r)) for r in df.select("doc_id", "text", "depth").collect())
    assert key(back) == key(docs)
    size = {r["shard"]: r["b"] for r in back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.countDistinct("doc_id").alias("n")).filter("n > 1").collect()}
    assert len(size) > 3
    assert max(size.values()) <= 2000
    sharding.write_shards(docs, str(tmp_path / "one"), 1 << 30)
    assert os.listdir(tmp_path / "one") != []
    assert spark.read.parquet(str(tmp_path / "one")).count() == 303


@pytest.mark.parametrize("limit", [1 << 30, 3000, 100])
def test_shards_fit_and_cover(docs, limit):
    got = sharding.shards(docs, limit).collect()
    assert len(got) == docs.count()
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    assert all(size[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= limit or r["oversized"]) for r in got)
    assert sharding.shards(docs.limit(0), limit).count() == 0


def test_pipeline_equals_brute_force_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    passage, near = text(45), text(100)
    rows = [(i, text(80), "en") for i in range(30)] + [(100 + i, f"{text(60)} {passage} {text(50)}", "de") for i in range(6)] + [(200 + i, f"{near} {text(1)}", "en") for i in range(5)]
    rows += [(300, "short", "en"), (301, None, "en"), (302, "", None), (303, "x " * 90, "en"), (304, "a$ # &% *** " * 60 + text(70), "en"), (None, text(90), "en"), (None, None, None), (305, text(40_000), "de")]
    rows += [(1, rows[1][1], "en"), (2, text(70), "de"), (3, None, "de")]
    docs = spark.createDataFrame([(i, t, y, "s", len(t or ""), i, 1) for i, t, y in rows], "doc_id long, text string, lang string, source string, n_chars long, _k long, kept int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen.append([x.asDict() for x in now.collect()])
        if len(seen) < 5:
            assert now.columns == docs.columns
            now = spark.createDataFrame(seen[-1], docs.schema)
    one, two, three, four, five = seen
    key = lambda rows: sorted((str(x["doc_id"]), x["text"]) for x in rows)
    assert key(one) == sorted((str(i), t) for i, t, _ in rows if t and i not in (300, 303, 304))
    left = {}
    for x in sorted(one, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0)):
        w = x["text"].split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if not any(100 * len(s & o) >= 80 * len(s | o) for o in left.values()):
            left[str(x["doc_id"]), x["text"]] = s
    assert key(two) == sorted(left)
    n = collections.Counter(x["text"][k : k + 200] for x in two for k in range(len(x["text"]) - 199))
    for x, y in zip(sorted(two, key=lambda x: (str(x["doc_id"]), x["text"][:30])), sorted(three, key=lambda x: (str(x["doc_id"]), x["text"][:30])), strict=True):
        gone = set()
        for k in range(len(x["text"]) - 199):
            if n[x["text"][k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        kept = "".join(c for k, c in enumerate(x["text"]) if k not in gone)
        assert (y["text"], y["n_chars"]) == (kept, len(kept))
    assert all(len(x["text"]) < 800 for x in three if x["doc_id"] in range(100, 106))
    assert set(key(four)) == set(key(three))
    assert len(four) > len(three)
    enc = bpe.encoding(*tokenizer())
    assert sorted((str(x["doc_id"]), x["n_tokens"], x["decoded_sha256"]) for x in five) == sorted((str(x["doc_id"]), len(enc.encode_ordinary(x["text"])), hashlib.sha256(x["text"].encode()).hexdigest()) for x in four)


def test_pipeline_of_an_empty_table_and_its_folders(spark, tmp_path):
    import corpus_pipeline
    from paretide.llm import shared

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = len(shared._made)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(shared._made) <= before + 1  # only the last stage's input is left


def test_pipeline_keeps_one_of_equal_rows_and_of_rows_without_id(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(90))
    twice, unnamed, both, one, other = (text() for _ in range(5))
    rows = [(1, twice), (1, twice), (None, unnamed), (None, unnamed), (None, unnamed + " end"), (2, both), (None, both), (3, one), (3, other), (4, text())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(x["doc_id"], x["text"]) for x in corpus_pipeline.ngram_jaccard_join(spark, docs, str(tmp_path)).collect()]
    assert sorted((i, t) for i, t in left if i is not None) == sorted([(1, twice), (2, both), (3, one), (3, other), rows[-1]])
    assert [t[: len(unnamed)] for i, t in left if i is None] == [unnamed]
    after = corpus_pipeline.suffix_array_dedup(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in left], docs.schema), str(tmp_path))
    assert sorted(x["text"] for x in after.collect()) == sorted(t for _, t in left)
