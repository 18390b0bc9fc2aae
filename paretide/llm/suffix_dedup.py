"""Operator 3, suffix-array dedup: bytes covered by a repeated string of ``width`` bytes are removed.

Method: depth-limited radix sort. Suffixes are dealt by a content-chosen anchor (``repeats``) and then ordered,
within a group, by most-significant-digit passes of ``DIGIT`` bytes down to ``width`` bytes and no deeper. After
each pass a suffix that is alone in its group retires; the groups that remain at the end are the repeated windows.
A digit is sorted by a 64-bit fingerprint; neighbours are then compared byte by byte, and if two digits share a
fingerprint the pass is sorted by the bytes themselves, so equality is exact.

Defined results: null text is empty; a text shorter than ``width`` has no window; equal rows repeat each other, and so
do rows with one doc_id or none; an empty table gives an empty table; extra columns, of any name, are kept by ``dedup``
and play no part (those named like its counts are replaced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import BYTE_VALUE, U, mix, prefix, span, texts_of
from .repeats import HOT_WINDOWS, Group, Windows, covered, keyed, mask_of, with_spans
from .shared import frugal

WIDTH = 200
DIGIT = 40


def _packed(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros after the end)."""
    out = np.zeros(len(x), dtype=U)
    for i in range(8):
        out <<= U(8)
        out[: len(x) - i] |= x[i:]
    return out


def radix_passes(g: Group, of: Windows, digit: int = DIGIT) -> tuple[np.ndarray, np.ndarray]:
    """No values, and which windows' symbols occur twice or more."""
    sums, packed = prefix(BYTE_VALUE[g.x]), _packed(g.x)
    out = g.c[g.run] > 1
    alive = np.arange(len(g.run))
    group = (np.unique(g.m, return_inverse=True)[1][g.run] << 10) | g.back  # the anchor and its place, below 1024
    for depth in range(0, of.width, digit):
        size = min(digit, of.width - depth)
        at = g.pos[alive] + depth
        key = mix(group.astype(U) * U(0xD6E8FEB86659FD93) + span(sums, at, at + size))
        # the digit's bytes, eight at a time; the last eight overlap, or reach no further than the digit
        if size >= 8:
            words = [packed[at + i] for i in sorted({*range(0, size - 7, 8), size - 8})]
        else:
            words = [packed[at] >> U(8 * (8 - size))]

        def neighbours(order: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
            same = np.ones(max(0, len(order) - 1), dtype=bool)
            for c in columns:
                same &= c[order[1:]] == c[order[:-1]]
            return same

        order = np.argsort(key, kind="stable")
        same = neighbours(order, [group, *words])
        if (same != neighbours(order, [key])).any():  # two digits or groups share a fingerprint
            order = np.lexsort([*words, group])
            same = neighbours(order, [group, *words])
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.cumsum(np.append(True, ~same))[: len(order)]
        edge = np.concatenate([[False], same, [False]])
        stay = np.sort(order[(edge[1:] | edge[:-1])[: len(order)]])  # a suffix alone in its group retires
        alive, group = alive[stay], rank[stay]
        if not len(alive):
            break
    out[alive] = True
    return np.zeros(len(out), dtype=np.int64), out


def _windows(width: int) -> Windows:
    return Windows(width, min(24, max(1, width // 4)), False)


@frugal
def _cleaned(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        spans = batch.column("spans")
        n, removed, count, kept = [], [], [], []
        for r in range(batch.num_rows):
            text = data[offsets[r] : offsets[r + 1]]
            n.append(len(text))
            if spans[r].is_valid:
                gone = mask_of(spans, r, len(text), width)
                removed.append(int(gone.sum()))
                count.append(int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()))
                kept.append(text[~gone].tobytes())
            else:
                removed.append(0)
                count.append(0)
                kept.append(text.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["row", *COUNTS, "kept"])


COUNTS = ("n_bytes", "n_removed", "n_spans")


def _deduped(docs: DataFrame, width: int, hot: int = HOT_WINDOWS) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): all columns but the text in one struct, so that no name can clash."""
    base = keyed(docs)
    spans = covered(base, _windows(width), radix_passes, True, hot)
    schema = T.StructType([base.schema["row"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("kept", T.BinaryType())])
    return with_spans(base, spans).mapInArrow(partial(_cleaned, width=width), schema)


def dedup(docs: DataFrame, width: int = WIDTH, hot: int = HOT_WINDOWS) -> DataFrame:
    """Every document without its text, with n_bytes, n_removed, n_spans and the kept bytes (``kept``, binary)."""
    others = [c for c in docs.columns if c.lower() not in ("text", *COUNTS, "kept")]
    return _deduped(docs, width, hot).select(*[F.col("row").getField(c).alias(c) for c in others], *COUNTS, "kept")


@frugal
def _as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], names=["row", "text"])


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the kept text in its own columns; a character that lost a byte goes, n_chars follows the text."""
    slim = _deduped(docs, width).select("row", "kept")
    out = slim.mapInArrow(_as_text, T.StructType([slim.schema["row"], T.StructField("text", T.StringType())]))

    def column(name: str) -> Column:
        if name.lower() == "text":
            return F.col("text").alias(name)
        return (F.char_length("text").cast(docs.schema[name].dataType) if name == "n_chars" else F.col("row").getField(name)).alias(name)

    return out.select(*[column(c) for c in docs.columns])


@frugal
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *COUNTS)] + [pa.array(sha, pa.string())], names=["doc_id", *COUNTS, "kept_sha256"])


def op3(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup(slim).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
