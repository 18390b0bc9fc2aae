"""Exact search for repeated windows of W symbols (bytes or words) in a corpus; serves op3 and op5.

Only runs of windows travel, never single suffixes. Each window has an anchor: its k-gram of smallest hash, a
choice that depends on the window alone, so equal windows have equal anchors at equal offsets. Neighbouring
windows of a document with one anchor form a run. The steps:

1. runs whose anchor occurs once (op5: in one document only) cannot repeat and go, by a pre-aggregated count;
2. anchors under which all runs are identical are decided by that count alone;
3. the other anchors are the groups to search: one copy of each distinct run is cut from its text, and a kernel
   orders the suffixes of each group (given by the caller: radix passes for op3, suffix subtrees for op5);
4. groups of more than ``hot`` windows in distinct runs are dealt again by whole windows, pre-aggregated.

Hot passages cost little: copies are pre-aggregated in 1, join sides split on skew in 1 and 3.

Equality: two runs are the same if the 64-bit hashes of their anchor and of their content are both equal; within a
group the kernels compare the symbols themselves (bytes, or 64-bit hashes of words); in 4 windows are compared by two
independent 64-bit hashes.

A row is named by ``k``, its doc_id (the least long if null), and ``t``, which is 0 where the doc_id is unique and a
hash of the text elsewhere. So rows that share a doc_id are told apart, and only equal rows share a name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BLOCK, BYTE_VALUE, U, blocks, mix, prefix, signed, sliding_min, span, texts_of, word_hashes
from .shared import BROADCAST_KEYS, freed, frugal, written

_POS_BITS = U(22)
_LOW = (U(1) << _POS_BITS) - U(1)
#: Symbols of runs that a kernel holds at once.
CHUNK = 1 << 20
#: Windows in the distinct runs of a group that is searched in one task: a few hundred MB.
HOT_WINDOWS = 2_000_000


@dataclass(frozen=True)
class Windows:
    """``width`` symbols a window, anchors of ``gram`` symbols; ``words``: symbols are words, else bytes."""

    width: int
    gram: int
    words: bool


def runs_of(x: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor's offset in the first window, anchor hash, content hash) of each run."""
    n = len(x)
    if n < width:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(0, dtype=U),) * 2
    sums = prefix(x)
    at = np.arange(n - gram + 1)
    g = span(sums, at, at + gram)
    best = sliding_min((g & ~_LOW) | at.astype(U), width - gram + 1)
    anchor = (best & _LOW).astype(np.int64)
    count = len(anchor)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    valid = offsets[row + 1] >= np.arange(count) + width
    new = np.ones(count + 1, dtype=bool)
    new[1:count] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new[:-1] & valid)
    breaks = np.flatnonzero(new | np.append(~valid, True))
    size = breaks[np.searchsorted(breaks, first, side="right")] - first
    offset = anchor[first] - first
    content = mix(span(sums, first, first + size - 1 + width) + size.astype(U) * U(0x9FB21C651E98DF25) + offset.astype(U) * U(0xC2B2AE3D27D4EB4F))
    return row[first], first - offsets[row[first]], size, offset, g[anchor[first]], content


def symbols(data: np.ndarray, offsets: np.ndarray, of: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, symbols, offsets of the rows, symbols cut away before) by block; long rows come in overlapping pieces."""
    if of.words:
        source = word_hashes(data, offsets)
    else:
        source = ((i, j, BYTE_VALUE[data[offsets[i] : offsets[j]]] if j > i + 1 or offsets[j] - offsets[i] <= BLOCK else None, offsets[i : j + 1] - offsets[i]) for i, j in blocks(offsets))
    for i, _, x, rows in source:
        if len(rows) > 2 or rows[-1] <= BLOCK:
            yield i, x, rows, 0
            continue
        for a in range(0, int(rows[-1]), BLOCK):
            b = min(a + BLOCK + of.width - 1, int(rows[-1]))
            part = x[a:b] if x is not None else BYTE_VALUE[data[offsets[i] + a : offsets[i] + b]]
            yield i, part, np.array([0, b - a]), a


@frugal
def _emit_runs(batches: Iterator[pa.RecordBatch], of: Windows) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        k, t = batch.column("k").to_numpy(), batch.column("t").to_numpy()
        for i, x, rows, cut in symbols(data, offsets, of):
            row, first, size, offset, m, s = runs_of(x, rows, of.width, of.gram)
            if len(row):
                at = ((first + cut) << 20) | (size << 10) | offset
                yield pa.RecordBatch.from_arrays([pa.array(signed(m)), pa.array(k[i + row]), pa.array(t[i + row]), pa.array(signed(s)), pa.array(at)], names=["m", "k", "t", "s", "at"])


@frugal
def _cut_runs(batches: Iterator[pa.RecordBatch], of: Windows) -> Iterator[pa.RecordBatch]:
    """One row for each wanted run of a text, with its symbols."""
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        wanted = batch.column("wanted")
        inner, bounds = wanted.flatten(), wanted.offsets.to_numpy()
        bounds = bounds - bounds[0]
        fields = {name: inner.field(name).to_numpy(zero_copy_only=False) for name in ("m", "s", "at", "c", "d")}
        for r in range(batch.num_rows):
            lo, hi = int(bounds[r]), int(bounds[r + 1])
            text = data[offsets[r] : offsets[r + 1]]
            if of.words:
                parts = [h for _, _, h, _ in word_hashes(text, np.array([0, len(text)]))]
                text = parts[0] if parts else text[:0]
            at = fields["at"][lo:hi]
            first, size = at >> 20, (at >> 10) & 1023
            blobs = [text[a : a + n - 1 + of.width].tobytes() for a, n in zip(first.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fields["m"][lo:hi]), pa.array(fields["s"][lo:hi]), pa.array(at & 0xFFFFF), pa.array(fields["c"][lo:hi]), pa.array(fields["d"][lo:hi]), pa.array(blobs, type=pa.binary())], names=["m", "s", "shape", "c", "d", "blob"])


@dataclass
class Group:
    """The windows of some groups of runs: ``run`` of each window, its offset in the run, its place in ``x`` (bytes or hashes of words)."""

    x: np.ndarray
    m: np.ndarray
    s: np.ndarray
    c: np.ndarray
    d: np.ndarray
    run: np.ndarray
    j: np.ndarray
    pos: np.ndarray
    back: np.ndarray  # of the anchor in the window

    @staticmethod
    def of(rows: pa.Table, of: Windows) -> Group:
        m, s, shape, c, d = (rows.column(n).combine_chunks().to_numpy() for n in ("m", "s", "shape", "c", "d"))
        raw = b"".join(rows.column("blob").to_pylist())
        x = np.frombuffer(raw, dtype=U if of.words else np.uint8)
        size, offset = shape >> 10, shape & 1023
        ends = np.cumsum(size - 1 + of.width)
        start = ends - (size - 1 + of.width)
        run = np.repeat(np.arange(len(m)), size)
        j = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        return Group(x, m, s, c, d, run, j, start[run] + j, offset[run] - j)


#: Gives each window a value, and says which windows have one.
Search = Callable[[Group, Windows], tuple[np.ndarray, np.ndarray]]


@frugal
def _search(batches: Iterator[pa.RecordBatch], of: Windows, values: Search) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by m. Neighbouring windows of a run with equal values go out as one row."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0

    def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        g = Group.of(pa.Table.from_batches(rows), of)
        v, some = values(g, of)
        new = np.ones(len(v), dtype=bool)
        new[1:] = (v[1:] != v[:-1]) | (some[1:] != some[:-1]) | (g.run[1:] != g.run[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(v))
        keep = some[first]
        first, last = first[keep], last[keep]
        return pa.RecordBatch.from_arrays([pa.array(g.m[g.run[first]]), pa.array(g.s[g.run[first]]), pa.array(g.j[first]), pa.array(g.j[last - 1] + 1), pa.array(v[first])], names=["m", "s", "lo", "hi", "v"])

    for batch in batches:
        m = batch.column("m").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, m[1:] != m[:-1])), len(m))
        sizes = pa.compute.binary_length(batch.column("blob")).to_numpy()
        total = np.append(0, np.cumsum(sizes))
        last = held[-1].column("m")[-1].as_py() if held else None
        at = 0
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held_bytes + total[a] - total[at] > CHUNK * (8 if of.words else 1) // 2 and m[a] != last and (a > at or held):
                if a > at:
                    held.append(batch.slice(at, a - at))
                yield out(held)
                held, held_bytes, at = [], 0, a
            last = m[b - 1]
        if at < len(m):
            held.append(batch.slice(at))
            held_bytes += int(total[-1] - total[at])
    if held:
        yield out(held)


@frugal
def _whole_windows(batches: Iterator[pa.RecordBatch], of: Windows) -> Iterator[pa.RecordBatch]:
    """Each window of the runs as a row with two independent hashes of its symbols."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            g = Group.of(pa.Table.from_batches([batch.slice(lo, 4096)]), of)
            x = g.x if of.words else BYTE_VALUE[g.x]
            sums, other = prefix(x), prefix(mix(x ^ U(0x5851F42D4C957F2D)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(span(y, g.pos, g.pos + of.width))) for y in (sums, other)] + [pa.array(g.m[g.run]), pa.array(g.s[g.run]), pa.array(g.j), pa.array(g.c[g.run]), pa.array(g.d[g.run])], names=["h", "h2", "m", "s", "lo", "c", "d"])


def covered(docs: DataFrame, of: Windows, search: Search, count_all: bool, hot: int = HOT_WINDOWS) -> DataFrame:
    """Rows (k, t, a, b): windows a <= i < b of the rows named (k, t) are repeats.

    ``docs`` is ``keyed``. ``count_all``: a window is a repeat if its symbols stand anywhere else; otherwise, if they
    stand in a document with a smaller ``k``.
    """
    runs = docs.select("k", "t", "text").mapInArrow(partial(_emit_runs, of=of), "m long, k long, t long, s long, at long")
    seen = runs.groupBy("m").agg(F.count("*").alias("n"), F.min("k").alias("d"), F.max("k").alias("e"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    # written, so that the join below has a plain exchange on both sides and Spark can split a hot anchor's rows
    seen = written(seen.filter("n > 1" if count_all else "d < e").select("m", "d", (F.col("s0") != F.col("s1")).alias("multi")), "anchors")
    found = written(runs.join(seen, "m"), "runs")
    freed(seen)

    single = found.filter(~F.col("multi"))
    if not count_all:
        single = single.filter("k > d")
    first, size = F.shiftright("at", 20), F.shiftright("at", 10).bitwiseAND(1023)
    single = single.select("k", "t", first.alias("a"), (first + size).alias("b"))

    many = found.filter("multi").select("m", "s", "k", "t", "at")
    distinct = written(many.groupBy("m", "s").agg(F.count("*").alias("c"), F.min("k").alias("d"), F.min(F.struct("k", "t", "at")).alias("rep")), "distinct")
    large = distinct.groupBy("m").agg(F.sum(F.shiftright("rep.at", 10).bitwiseAND(1023)).alias("n")).filter(F.col("n") > hot).select("m")
    wanted = distinct.groupBy(F.col("rep.k").alias("k"), F.col("rep.t").alias("t")).agg(F.collect_list(F.struct("m", "s", F.col("rep.at").alias("at"), "c", "d")).alias("wanted"))
    # the kernel takes all columns of docs, so that this join and with_spans share one exchange of the texts
    cut = docs.join(wanted, ["k", "t"]).mapInArrow(partial(_cut_runs, of=of), "m long, s long, shape long, c long, d long, blob binary")
    some_hot = large.limit(1).count() > 0
    if some_hot:
        cut = written(cut, "cut")
    rest = cut.join(large, "m", "left_anti") if some_hot else cut
    values = rest.repartition("m").sortWithinPartitions("m").mapInArrow(partial(_search, of=of, values=search), "m long, s long, lo long, hi long, v long")
    if some_hot:
        each = cut.join(large, "m", "left_semi").mapInArrow(partial(_whole_windows, of=of), "h long, h2 long, m long, s long, lo long, c long, d long")
        total = each.groupBy("h", "h2").agg(F.sum("c").alias("n"), F.min("d").alias("v"))
        each = each.join(total.filter("n > 1"), ["h", "h2"]).select("m", "s", "lo", (F.col("lo") + 1).alias("hi"), F.lit(0).cast("long").alias("v") if count_all else "v")
        values = values.union(each)
    placed = many.join(values, ["m", "s"])
    if not count_all:
        placed = placed.filter("k > v")
    return single.union(placed.select("k", "t", (first + F.col("lo")).alias("a"), (first + F.col("hi")).alias("b")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the array ``spans`` of each (null: none)."""
    lists = spans.groupBy("k", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(lists, ["k", "t"], "left")


def keyed(docs: DataFrame) -> DataFrame:
    """(k, t, text, row): the name of each row, its text, and all its columns but the text in one struct."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("row"))
    own = F.xxhash64("text")
    name = F.when(F.col("id").isNull(), own).otherwise(F.lit(0).cast("long"))
    repeated = written(docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).count().filter("count > 1").select("id", F.lit(True).alias("again")), "repeated")
    if n := repeated.count():
        rows = rows.join(F.broadcast(repeated) if n <= BROADCAST_KEYS else repeated.hint("shuffle_merge"), "id", "left")
        name = F.when(F.col("id").isNull() | F.col("again"), own).otherwise(F.lit(0).cast("long"))
    return rows.select(F.coalesce("id", F.lit(-(2**63))).alias("k"), name.alias("t"), "text", "row")


def mask_of(spans: pa.Array, row: int, n: int, width: int) -> np.ndarray:
    """Which of ``n`` symbols the windows in ``spans[row]`` cover."""
    depth = np.zeros(n + 1, dtype=np.int32)
    if spans[row].is_valid:
        lo, hi = spans.offsets[row].as_py(), spans.offsets[row + 1].as_py()
        inner = spans.values
        a = inner.field("a").to_numpy(zero_copy_only=False)[lo:hi]
        b = inner.field("b").to_numpy(zero_copy_only=False)[lo:hi]
        np.add.at(depth, a, 1)
        np.add.at(depth, b - 1 + width, -1)
    return np.cumsum(depth[:n]) > 0


__all__ = ["HOT_WINDOWS", "Group", "Windows", "covered", "keyed", "mask_of", "with_spans"]
