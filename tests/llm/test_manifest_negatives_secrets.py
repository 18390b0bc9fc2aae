"""Operators 11 to 13 against brute force, and on nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paretide.llm import hard_negatives, merkle, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g string, spans string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, text):
    return sha("".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")) + field(text))


def tree(level):
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, j in enumerate(at):
            run = level[j // 3 * 3 : j // 3 * 3 + 3]
            paths[i].append((run[: j % 3], run[j % 3 + 1 :]))
        level, at = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)], [j // 3 for j in at]
    return level[0], paths


def manifest(rows):
    of = collections.defaultdict(list)
    for r in rows:
        of[r["source"]].append(r)
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    subs, paths = {}, []
    for s in names:
        of[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        subs[s], own = tree([leaf(r, r["text"]) for r in of[s]])
        paths += [(r, p) for r, p in zip(of[s], own, strict=True)]
    root, tops = tree([subs[s] for s in names])
    top = dict(zip(names, tops, strict=True))
    for r, p in paths:
        p = p + top[r["source"]]
        text = r["text"]
        if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        node = leaf(r, text)
        for left, right in p:
            node = sha("".join(left) + node + "".join(right))
        yield (r["doc_id"], leaf(r, r["text"]), subs[r["source"]], root, sha("".join("".join(a + b) for a, b in p)), node, node == root)


@pytest.mark.parametrize("levels", [1, 8])
def test_manifest_equals_brute_force(spark, levels):
    r = random.Random(3)
    rows = [(i, r.choice(["a\nb", "", None, "Ünï\n" * 50, "x"]) if i % 7 else f"line\n{i}", r.choice(["en", None]), "hot" if i % 3 else f"s{i % 13}", i if i % 5 else None, "x", "y", "z") for i in range(-3, 120)]
    rows += [(5, "line\n", "en", "hot", 1, "x", "y", "z")] * 3 + [(None, "no id", "en", None, 1, "x", "y", "z"), (None, None, None, None, None, None, None, None), (9, "t", "en", "Ü", 1, "", "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = merkle.op11(docs, levels=levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = list(manifest([x.asDict() for x in docs.collect()]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert 0 < sum(x[-1] for x in want) < len(want)


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame([(1, "t", "en", "s", 1, "", "", "")], DOCS)
    got = merkle.op11(docs).first()
    assert got["leaf"] == got["subroot"] == got["root"] == got["folded_root"]
    assert (got["proof_sha256"], got["verified"]) == (sha(""), True)
    assert merkle.op11(docs.limit(0)).count() == 0


def mined(rows):
    used = []
    for i, label, v in rows:
        if i is not None and label is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) and abs(x) < 65_536 for x in v):
            used.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.floor(256.0 * np.array(v)).astype(np.int64)))
    out = []
    for a, label, q in used:
        if a % 100:
            continue
        scored = [(int(q @ x), i, other) for i, other, x in used if i != a]
        for p, pid in sorted(((s, i) for s, i, o in scored if o == label), key=lambda x: (-x[0], x[1]))[:5]:
            near = sorted(((s, i) for s, i, o in scored if o != label and 80 * p <= 100 * s <= 100 * p), key=lambda x: (-x[0], x[1]))[:5]
            out += [(a, pid, k + 1, i, p, s) for k, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("cells", "sample", "chunk"), [(64, 20_000, 1 << 18), (4, 30, 24)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, cells, sample, chunk):
    monkeypatch.setattr(hard_negatives, "SAMPLE", sample)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "BLOCK", 200)
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(0, 4)), [float(x) for x in r.normal(size=6) * (30 if i % 90 == 0 else 1)]) for i in range(700)]
    rows += [(1000 + i, i % 4, rows[200][2]) for i in range(60)]  # copies of an anchor
    rows += [(2000, None, rows[0][2]), (2001, 1, None), (2002, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, 1, [float("nan")] * 6), (2004, 1, [float("inf")] + [0.0] * 5), (None, 1, rows[0][2]), (2005, 1, [0.0] * 6), (2006, 1, []), (2007, 1, [1.0, 2.0]), (2008, 2, [1e30] + [0.0] * 5), (2100, 3, [0.0] * 6)]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "vec_id long, label int, embedding array<double>, score int, rank int, row int").repartition(4)
    got = hard_negatives.hard_negatives(df, cells=cells).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == mined(rows)


def test_hard_negatives_of_small_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.op12(spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives.op12(spark.createDataFrame([(1, 1, [1.0])], schema)).count() == 0
    assert hard_negatives.op12(spark.createDataFrame([(100, 1, [1.0])], schema)).count() == 0
    two = spark.createDataFrame([(100, 1, [1.0]), (101, 1, [1.0]), (102, 2, [0.9]), (103, 2, [0.9]), (104, 3, [0.5])], schema)
    assert [tuple(r) for r in hard_negatives.op12(two).orderBy("rank").collect()] == [(100, 101, 1, 102, 65536, 58880), (100, 101, 2, 103, 65536, 58880)]


def base(text):
    found = []
    for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        if len(m[1]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            found.append((m.start(), 1, f"access:{m.start()}:{m.end()}"))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 16:
            found.append((m.start(), 2, f"hex:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_secrets_equal_brute_force_and_add_random_keys_only(spark):
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choice("eeeettaaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))
    key = lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = [None, "", " ", 'token = "abcdefghijkl"', "TOKEN:secret: abcdefghijklmnop", "ſecret=abcdefghijklmnop", "api_key='Zz9+/_.=-Zz9' x", "AKIA0123456789ABCD AKIA0123456789ABC", "0123456789abcdef0123 0123456789abcde",
        "password" + " " * 5000 + "= aaaaaaaaaaaaaaaa", "é日本 Secret=" + "q" * 20 + " é" + "f" * 16, "token=" * 4000, prose(30_000)]
    planted = {}
    for i in range(60):
        k = key() if i % 2 else base64.b64encode(r.randbytes(33)).decode()
        planted[len(texts)] = k
        texts.append(f"{prose(200)} {k} {prose(200)} src/main/resources/templates/defaultAccountManager {prose(9).replace(' ', '')}")
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "a", None, None, None, None, None, None)], DOCS)
    got = {x["doc_id"]: x for x in secrets.op13(docs).collect()}
    assert len(got) == docs.count()
    caught = 0
    for i, t in enumerate(texts):
        want, g = base(t or ""), got[i]
        assert g["base_sha256"] == sha(",".join(want))
        assert [g[c] for c in ("n_assign", "n_access", "n_hex")] == [sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex")]
        spans = g["spans"].split(",") if g["spans"] else []
        assert [x for x in spans if not x.startswith("random")] == want
        for x in spans:
            if x.startswith("random"):
                _, s, e = x.split(":")
                assert t[int(s) : int(e)].rstrip("=") == planted[i].rstrip("=")
                caught += 1
    assert caught >= 55
    assert secrets.op13(docs.limit(0)).count() == 0


def test_chances_are_even_for_random_keys_and_tiny_for_names():
    r = random.Random(1)
    for name, letters in secrets.ENCODINGS.items():
        p = secrets.chances(["".join(r.choice(letters) for _ in range(40)) for _ in range(2000)], name)
        assert np.mean(p < 0.01) < 0.04 and np.mean(p < 1e-5) < 0.002
    for word in ("InternationalizationConfiguration", "get_the_default_user_account_name", "abcdefghijklmnopqrstuvwxyzABCDEFG"):
        assert secrets.chances([word], secrets.encoding(word))[0] < 1e-4


def test_long_runs_of_white_space_are_encoded_by_the_rule(spark):
    from paretide.llm import bpe
    from paretide.llm.queries import tokenizer

    enc = bpe.encoding(*tokenizer())
    r = random.Random(11)
    for _ in range(300):
        text = "".join(r.choice(["a", "word", "!", "é", "\x1c", "7", "'s", *[c * r.randint(1, 30) for c in " \t\n\r\x85\xa0　"]]) for _ in range(r.randint(1, 25)))
        assert bpe.encode(text, enc, limit=3, long=8) == enc.encode_ordinary(text)
    texts = [a + c * 2_000_000 + b for c in (" ", "\n", "\t") for a, b in (("", ""), ("x", ""), ("", "y"), ("x", "y"))] + ["x" + " \n\t\r" * 500_000 + "y " * 150_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.op6(docs, *tokenizer()).collect()
    assert {x["doc_id"]: x["decoded_sha256"] for x in got} == {i: sha(t) for i, t in enumerate(texts)}
    assert bpe.op6(docs.limit(0), *tokenizer()).count() == 0


def test_thresholds_count_every_ordinary_run():
    text = "ordinary words of a long text " * 200 + "key QX7Z2M9K4W1P8R5T end"
    found, ordinary = secrets.candidates(text, [])
    [(_, _, name, length, _)] = found
    letters = "".join(c for c in text[: text.index("QX7Z")].upper() + " end".upper() if c in secrets.ENCODINGS[name])
    assert {x[:2] for x in ordinary} == {(name, length)}
    assert sum(x[3] for x in ordinary) == -(-len(letters) // 16) > 20
    one, many = secrets.ordinary_bins(letters, name, 16), [secrets.chances([letters[i : i + 16]], name)[0] for i in [*range(0, len(letters) - 15, 16), len(letters) - 16][: -(-len(letters) // 16)]]
    assert sorted(one.elements()) == sorted(map(secrets._bin, many))
