"""Operator 12, hard-negative mining over a vector-approximation file (Weber, Schek and Blott 1998).

Components are whole numbers. Each dimension is cut into cells at quantiles of a bounded sample, with the least and
greatest component of the whole table as outer edges, and a row's approximation is its cells, a byte a dimension.
What a row's score with an anchor can be at least and at most follows from tables of each cell's middle and half width,
looked up by the row's cells: the anchor times the middles, less or plus its sizes times the half widths. Only rows
whose bounds may enter a window that is still open are scored exactly, on the vectors beside the approximations.

Anchors are a stated query set. They come in chunks of a bounded number; a chunk is sent to all tasks, each of which
goes through its part of the file once for the positives and once for the negatives, so no vector is shuffled and no
pair of rows is formed. A task returns at most ``k`` rows for each window, and the tasks' rows are ranked together.
Scores of sampled rows are real ones, so the k-th best of them in a window is where its search starts.

Defined results: rows with a null vec_id, label, vector or component, or a component that isn't finite, take no part;
nor do vectors of another length than most, empty ones, and those with a component of 65,536 or more in size, whose
scores need not fit 64 bits. Zero vectors take part. Rows that share a vec_id stay rows of their own, but none of them is
another row to an anchor with that vec_id. Ties go to the smaller vec_id. Negative positive scores have no negatives. An
empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import frugal, scratch, written

ANCHOR_STEP, POSITIVES, NEGATIVES = 100, 5, 5
#: A negative's score is at least this many hundredths of the positive's.
LEAST = 80
#: Cells of a dimension, rows of the sample that sets their edges, and the size of components that take part.
CELLS, SAMPLE, LIMIT = 64, 20_000, 65_536
#: Numbers in the anchors of a chunk (4,096 anchors of 64 numbers) and in a block of rows.
CHUNK, BLOCK = 1 << 18, 1 << 17
#: Anchors compared at a time.
TILE = 256

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(table: DataFrame) -> DataFrame:
    """vec_id, label (as it is to be used) and v (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    rows = rows.filter("vec_id is not null and label is not null and v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT)))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()  # a row for each length
    rows = rows.filter(F.size("v") == (most["n"] if most else 0))
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def _whole(column: pa.Array) -> np.ndarray:
    """The rows' components: 256 times each, rounded down."""
    return np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False)).astype(np.int32).reshape(len(column), -1)


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


@frugal
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest component of each dimension, of a task's rows."""
    low = high = None
    for b in batches:
        if b.num_rows:
            q = _whole(b.column("v"))
            low = q.min(axis=0) if low is None else np.minimum(low, q.min(axis=0))
            high = q.max(axis=0) if high is None else np.maximum(high, q.max(axis=0))
    if low is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low.astype(np.int64)), pa.array(high.astype(np.int64))], names=["d", "low", "high"])


@frugal
def _approximated(batches: Iterator[pa.RecordBatch], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        q = _whole(b.column("v"))
        cells = np.stack([np.searchsorted(e, x, side="right") for e, x in zip(edges, q.T, strict=True)], axis=1).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _bytes(cells), _bytes(q)], names=["vec_id", "label", "cells", "q"])


class Cells:
    """The edges of each dimension's cells, and the tables of twice their middles and half widths."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int):
        self.edges = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="higher").T.astype(np.int64)
        first = np.concatenate([low[:, None], self.edges], axis=1)
        last = np.concatenate([self.edges - 1, high[:, None]], axis=1)
        self.middles, self.widths = (first + last).astype(float), (last - first).astype(float)
        self.most = np.maximum(np.abs(low), np.abs(high)).astype(float)

    def looked_up(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(cells.shape[1])
        return self.middles[at, cells], self.widths[at, cells]


def approximated(table: DataFrame, cells: int = CELLS) -> tuple[DataFrame, Cells, np.ndarray, np.ndarray] | None:
    """The file (row, vec_id, label, cells, q), its cells, and the sample's labels and components; None for an empty table."""
    rows = written(usable(table), "usable")
    n = rows.count()
    if not n:
        return None
    spans = rows.select("v").mapInArrow(_spans, "d long, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()  # a row for each dimension
    share = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    picked = rows.filter(share).limit(2 * SAMPLE).toPandas()  # equal rows share a hash: the limit bounds what comes
    if not len(picked):
        picked = rows.limit(SAMPLE).toPandas()
    sample = np.floor(256.0 * np.stack(picked["v"].to_numpy())).astype(np.int64)
    low, high = (np.array([r[c] for r in spans], dtype=np.int64) for c in ("low", "high"))
    made = Cells(sample, low, high, cells)
    file = rows.mapInArrow(partial(_approximated, edges=made.edges), "vec_id long, label long, cells binary, q binary")
    return written(file.withColumn("row", F.monotonically_increasing_id()), "file"), made, picked["label"].to_numpy(dtype=np.int64), sample


class Best:
    """The best ``k`` (score, id) of each of ``n`` windows: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.score, self.id = np.full((n, k), _LEAST), np.full((n, k), _MOST)
        self.least = least

    def bar(self) -> np.ndarray:
        """What a score must reach to enter each window."""
        return np.maximum(self.least, self.score[:, -1])

    def add(self, window: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        if not len(window):
            return
        k = self.score.shape[1]
        some = np.unique(window)
        w = np.concatenate([np.repeat(some, k), window])
        s, i = np.concatenate([self.score[some].ravel(), score]), np.concatenate([self.id[some].ravel(), ident])
        order = np.lexsort((i, -s.astype(float), w)) if np.abs(score).max() < 1 << 52 else np.array(sorted(range(len(w)), key=lambda x: (w[x], -int(s[x]), i[x])))
        w, s, i = w[order], s[order], i[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        keep = rank < k
        self.score[w[keep], rank[keep]], self.id[w[keep], rank[keep]] = s[keep], i[keep]

    def rows(self) -> pa.RecordBatch:
        w, r = np.nonzero(self.score != _LEAST)
        return pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(self.score[w, r]), pa.array(self.id[w, r])], names=["w", "score", "vec_id"])


class Anchors:
    """A chunk of anchors: ids, labels, components; and for each its windows of scores, ``low`` to ``high``."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, same: bool, k: int):
        self.ids, self.labels, self.q, self.same, self.k = ids, labels, q, same, k
        self.low = np.full((len(ids), 1), _LEAST)
        self.high = np.full((len(ids), 1), _MOST)
        self.least = self.low.copy()

    def start(self, sample: np.ndarray, labels: np.ndarray) -> None:
        """Lets the search start at the k-th best score of the sampled rows in each window. Sampled rows may be the anchor
        itself, so one more is taken; a rounded score is lowered by what it may be off."""
        for a in range(0, len(self.ids), TILE):
            b = slice(a, a + TILE)
            score = sample.astype(float) @ self.q[b].T.astype(float)
            off = 1 + np.abs(score).max() * 1e-12
            other = (labels[:, None] == self.labels[b]) == self.same
            for j in range(self.low.shape[1]):
                inside = np.where(other & (score >= self.low[b, j] + off) & (score <= self.high[b, j] - off), score, -np.inf)
                if len(inside) > self.k:
                    kth = -np.partition(-inside, self.k, axis=0)[self.k]
                    self.least[b, j] = np.where(np.isfinite(kth), np.maximum(self.low[b, j], np.where(np.isfinite(kth), kth - off, 0).astype(np.int64)), self.low[b, j])


@frugal
def _searched(batches: Iterator[pa.RecordBatch], anchors: Anchors, cells: Cells) -> Iterator[pa.RecordBatch]:
    """The best rows of each window among a task's rows; only those whose bounds may enter one are scored exactly."""
    n, windows = anchors.low.shape
    best = Best(n * windows, anchors.k, anchors.least.ravel())
    exact = anchors.q.astype(np.int64)
    size = max(1, BLOCK // exact.shape[1])
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            b = whole.slice(at, size)
            ids, labels, q = b.column("vec_id").to_numpy(), b.column("label").to_numpy(), _numbers(b.column("q"), np.int32).astype(np.int64)
            middles, widths = cells.looked_up(_numbers(b.column("cells"), np.uint8))
            for t in range(0, n, TILE):
                tile = slice(t, t + TILE)
                own = exact[tile].astype(float)
                centre, reach = middles @ own.T / 2, widths @ np.abs(own).T / 2
                reach += 1 + 1e-12 * (np.abs(own) @ cells.most)
                upper, lower = centre + reach, centre - reach
                bar = best.bar().reshape(n, windows)[tile]
                may = np.zeros(upper.shape, dtype=bool)
                for j in range(windows):
                    may |= (upper >= bar[:, j]) & (lower <= anchors.high[tile, j])
                may &= ((labels[:, None] == anchors.labels[tile]) == anchors.same) & (ids[:, None] != anchors.ids[tile])
                row, a = np.nonzero(may)
                for c in range(0, len(row), size):
                    r, x = row[c : c + size], a[c : c + size] + t
                    score = np.einsum("ij,ij->i", q[r], exact[x])
                    for j in range(windows):
                        into = (score >= anchors.low[x, j]) & (score >= best.bar()[x * windows + j]) & (score <= anchors.high[x, j])
                        best.add(x[into] * windows + j, score[into], ids[r[into]])
    yield best.rows()


def _ranked(file: DataFrame, anchors: Anchors, cells: Cells) -> DataFrame:
    """(w, rank, score, vec_id): the first ``k`` rows of each window; w is the anchor's place in the chunk times its windows."""
    found = file.select("vec_id", "label", "cells", "q").mapInArrow(partial(_searched, anchors=anchors, cells=cells), "w long, score long, vec_id long")
    first = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", first).filter(F.col("rank") <= anchors.k)


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(table: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, step: int = ANCHOR_STEP, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, every ``step``-th id.

    For each of an anchor's first ``positives`` rows of its label, the first ``negatives`` rows of other labels that score
    no more, and at least ``least`` hundredths as much.
    """
    spark = table.sparkSession
    with scratch(spark) as keep:
        made = approximated(table, cells)
        if made is None:
            return spark.createDataFrame([], _RESULT)
        file, tables, labels, sample = made
        queries = written(file.filter(F.col("vec_id") % step == 0).select("row", "vec_id", "label", "q"), "anchors")
        chunks = -(-queries.count() // max(1, CHUNK // 2 // sample.shape[1])) or 1
        out = None
        for chunk in range(chunks):
            own = queries.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == chunk).toPandas().sort_values(["vec_id", "row"])  # about CHUNK / 2 numbers
            if not len(own):
                continue
            q = np.stack([np.frombuffer(x, dtype=np.int32) for x in own["q"]]).astype(np.int64)
            of = own["vec_id"].to_numpy(), own["label"].to_numpy(), q
            near = Anchors(*of, same=True, k=positives)
            near.start(sample, labels)
            near_rows = _ranked(file, near, tables).collect()  # at most ``positives`` for each anchor of the chunk
            if not near_rows:
                continue
            far = Anchors(*of, same=False, k=negatives)
            far.high = np.full((len(q), positives), _LEAST)
            far.low = np.full((len(q), positives), _MOST)
            for r in near_rows:
                if r["score"] >= 0:
                    far.high[r["w"], r["rank"] - 1], far.low[r["w"], r["rank"] - 1] = r["score"], -(-least * r["score"] // 100)
            far.least = far.low.copy()
            far.start(sample, labels)
            pairs = [(int(r["w"]) * positives + r["rank"] - 1, int(of[0][r["w"]]), r["vec_id"], r["score"]) for r in near_rows]
            named = spark.createDataFrame(pairs, "w long, anchor_id long, positive_id long, positive_score long")
            found = _ranked(file, far, tables).join(F.broadcast(named), "w")  # a row for each window of the chunk
            found = found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            found = keep(written(found, "negatives"))
            out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], _RESULT)


def op12(table: DataFrame) -> DataFrame:
    return hard_negatives(table)
