"""Operator 1, toxicity by maximum-scoring segments.

Training counts in how many labelled training texts (equal texts once) each token occurs, with its beginnings of
four to eight letters as further terms, and scores each term by its log odds between toxic and clean text under an
informative Dirichlet prior (Monroe, Colaresi and Quinn 2008); only terms with a significant z score count, and
those for toxic text only if three toxic texts have them. A document is a sequence of token scores
with a small negative drift; the linear-time scan of Ruzzo and Tompa (1999) finds all maximal segments. Segments
get expectation values by Karlin and Altschul's extreme-value statistics; those above their expected number add up
to the document's evidence, and a logistic curve fitted on the training rows turns evidence into a score.

Defined results: null and empty texts have no evidence and get the curve's lowest score; a null doc_id is never
labelled or held out; a doc_id with several labels counts as toxic if one says so; null labels are ignored; equal
texts get equal scores; without training rows every score is 0; an empty table gives an empty table; extra columns
play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_KEYS, written

#: Weight of the prior in counts, the z score from which a term counts, and the fewest toxic texts with it.
PRIOR_TOKENS, Z, LEAST_TEXTS = 10_000.0, 3.0, 3
_BEGINNINGS = (8, 7, 6, 5, 4)
#: Labelled training rows that the model is fitted on at most, chosen by a hash of doc_id. All significant terms of
#: these rows are kept, so this bounds the model that every executor gets.
LABELLED = 200_000
#: Longest token whose score a task remembers.
_REMEMBERED = 64
DRIFT, CAP = 0.1, 8.0
THRESHOLD = 0.7
_TOKEN = re.compile(r"\w+")
#: Width and number of the bins of evidence on which the curve is fitted.
_BIN, _BINS = 0.5, 200


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def terms(token: str) -> tuple[str, ...]:
    """The token, and its beginnings (with a mark that no token holds) if it is longer."""
    return (token, *[f"{token[:k]}*" for k in _BEGINNINGS if len(token) > k])


def segments(scores: list[tuple[int, float]], n: int, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score) of ``n`` tokens, by the scan of Ruzzo and Tompa.

    ``scores`` has the tokens that don't score ``-drift``, as (place, score), in order. Linear time: each candidate
    is joined or closed once, and the stack keeps for each its nearest predecessor with a smaller left sum.
    """
    found: list[list] = []  # first, end, left sum, right sum, index of the nearest with a smaller left sum
    total, last = 0.0, 0
    for at, s in scores:
        total -= drift * (at - last)
        last = at + 1
        if s <= 0:
            total += s
            continue
        new = [at, at + 1, total, total + s, -1]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


@dataclass
class Model:
    """``weight``: score of each significant term; ``rate`` and ``k``: the extreme-value law; ``curve``: of evidence."""

    weight: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = 0.1
    curve: tuple[float, float] | None = None


def _sent(spark: SparkSession, model: Model) -> dict:
    """The arguments of the kernels: the terms once an executor, by broadcast, and the rest of the model."""
    return {"weight": spark.sparkContext.broadcast(model.weight), "model": replace(model, weight={})}


class _Scores(dict):
    """Score of a token, kept for the tokens seen lately."""

    def __init__(self, weight: dict[str, float]) -> None:
        super().__init__()
        self.weight = weight

    def __missing__(self, token: str) -> float | None:
        known = [w for t in terms(token) if (w := self.weight.get(t)) is not None]
        out = (max(known) if max(known) > 0 else min(known)) if known else None
        if len(token) > _REMEMBERED:
            return out
        if len(self) > 300_000:
            self.clear()
        self[token] = out
        return out


def evidence(text: str, model: Model, scores: _Scores) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum over the significant segments of ln(1 / expectation value), and those segments."""
    words = tokens(text)
    hit = [(i, s) for i, s in enumerate([scores[w] for w in words]) if s is not None]
    if not any(s > 0 for _, s in hit):
        return 0.0, []
    floor = math.log(model.k * len(words) + 1e-300)
    found = [(a, b, model.rate * s - floor) for a, b, s in segments(hit, len(words))]
    found = [x for x in found if x[2] > 0]
    return sum(x[2] for x in found), found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        rows = [(t, label, n) for label, c in enumerate(seen) for t, n in c.items()]
        for c in seen:
            c.clear()
        t, label, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(label, pa.int32()), pa.array(n, pa.int64())], names=["term", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            seen[toxic].update({t for w in set(tokens(text.as_py() or "")) for t in terms(w)})
            seen[toxic][""] += 1
            if len(seen[0]) + len(seen[1]) > 250_000:
                yield out()
    yield out()


def _evidence(batches: Iterator[pa.RecordBatch], weight: Broadcast, model: Model) -> Iterator[pa.RecordBatch]:
    scores = _Scores(weight.value)
    for batch in batches:
        x = [evidence(t.as_py() or "", model, scores)[0] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([min(int(v / _BIN + 0.999999), _BINS) for v in x], pa.int32()), batch.column("toxic")], names=["bin", "toxic"])


def _rate(p: list[tuple[float, float]]) -> float:
    """The positive solution of sum p * exp(rate * score) = 1, by bisection."""
    f = lambda r: sum(q * math.exp(min(700.0, r * s)) for s, q in p) - 1
    if sum(q * s for s, q in p) >= 0:  # no drift down: the law doesn't hold, so only long segments count
        return 0.5
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 100:
        hi *= 2
    for _ in range(80):
        lo, hi = (mid, hi) if f(mid := (lo + hi) / 2) < 0 else (lo, mid)
    return hi


def _curve(rows: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Logistic curve through counts (bin, toxic, n), with a few pseudo-rows at both ends; by Newton's method."""
    data = [(b * _BIN, t, float(n)) for b, t, n in rows] + [(0.0, 0, 2.0), (0.0, 1, 0.02), (_BINS * _BIN, 1, 2.0), (_BINS * _BIN, 0, 0.02)]
    scale = lambda x: math.log1p(x)
    a = b = 0.0
    for _ in range(60):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, t, n in data:
            x = scale(x)
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * x))))
            g0, g1 = g0 + n * (t - p), g1 + n * (t - p) * x
            w = n * p * (1 - p) + 1e-9
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        h00, h11 = h00 + 1e-3, h11 + 1e-3
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 4.0 / max(abs(da), abs(db), 1e-12))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, max(b, 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the labelled rows that aren't held out, ``LABELLED`` of them at most."""
    marks = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    if (n := marks.count()) > LABELLED:
        marks = marks.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 30)) < int(LABELLED / n * (1 << 30)))
        n = LABELLED
    hint = (lambda x: F.broadcast(x)) if n <= BROADCAST_KEYS else (lambda x: x.hint("shuffle_merge"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = texts.join(hint(marks), "doc_id").groupBy(F.xxhash64("text"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    rows = texts.join(hint(written(first, "train")), "doc_id").select("text", "toxic")
    by = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0))
    counts = rows.mapInArrow(_count, "term string, toxic int, n long").groupBy("term").agg(by(1).alias("t"), by(0).alias("c"))
    counts = written(counts.withColumn("kind", F.when(F.col("term").endswith("*"), F.length("term")).otherwise(F.when(F.col("term") == "", -1).otherwise(0))), "terms")
    totals = {r["kind"]: (r["t"], r["c"]) for r in counts.groupBy("kind").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()}  # a row for each length
    totals.pop(-1, None)
    model = Model()
    for kind, (t, c) in sorted(totals.items()):
        if not t or not c:
            continue
        a = PRIOR_TOKENS * (F.col("t") + F.col("c")) / (t + c)
        x, y = F.col("t") + a, F.col("c") + a
        odds = F.log(x / (t + PRIOR_TOKENS - x)) - F.log(y / (c + PRIOR_TOKENS - y))
        scored = counts.filter(F.col("kind") == kind).select("term", "t", odds.alias("w"), (odds / F.sqrt(1 / x + 1 / y)).alias("z"))
        scored = scored.filter((F.abs("z") >= Z) & ((F.col("w") < 0) | (F.col("t") >= LEAST_TEXTS)))
        for r in scored.collect():  # bounded by the labelled rows
            model.weight[r["term"]] = max(-CAP, min(CAP, r["w"]))
    if not model.weight:
        return model
    sent = _sent(docs.sparkSession, model)
    drawn = counts.filter((F.col("kind") == 0) & (F.col("c") > 0)).select("term", "c").mapInArrow(partial(_background, weight=sent["weight"]), "s double, c long").groupBy("s").agg(F.sum("c")).collect()  # scores are rounded: few rows
    clean = sum(n for _, n in drawn) + 1
    model.rate = _rate([(s, n / clean) for s, n in drawn] + [(CAP, 1 / clean)])
    positive = [(s, n / clean) for s, n in drawn if s > 0] + [(CAP, 1 / clean)]
    model.k = sum(p for _, p in positive)
    sent = {**sent, "model": replace(model, weight={})}
    bins = rows.mapInArrow(partial(_evidence, **sent), "bin int, toxic int").groupBy("bin", "toxic").count().collect()  # at most 402 rows
    model.curve = _curve([tuple(r) for r in bins])
    return model


def _background(batches: Iterator[pa.RecordBatch], weight: Broadcast) -> Iterator[pa.RecordBatch]:
    """The scores that clean text draws."""
    scores = _Scores(weight.value)
    for batch in batches:
        s = [-DRIFT if (x := scores[t]) is None else round(x, 1) for t in batch.column("term").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.float64()), batch.column("c")], names=["s", "c"])


def _score(batches: Iterator[pa.RecordBatch], weight: Broadcast, model: Model) -> Iterator[pa.RecordBatch]:
    scores = _Scores(weight.value)
    a, b = model.curve or (-math.inf, 0.0)
    for batch in batches:
        p, n = [], []
        for t in batch.column("text"):
            x, found = evidence(t.as_py() or "", model, scores)
            p.append(1 / (1 + math.exp(min(700.0, -(a + b * math.log1p(x))))) if model.curve else 0.0)
            n.append(len(found))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "held_out", "score", "predicted", "n_segments"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and n_segments of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(partial(_score, **_sent(docs.sparkSession, model)), "doc_id long, held_out boolean, score double, predicted int, n_segments int")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
