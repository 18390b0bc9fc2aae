"""Operator 5, substring dedup: words covered by a 13-word window that also starts in an earlier document go.

Method: prefix-partitioned suffix trees. Suffixes are dealt by a prefix (read from the window's content-chosen
anchor, see ``repeats``) into groups that fit in memory; a group that is too large is split by a longer prefix:
first by the place of the anchor in the window, then by whole windows. In a group the suffixes are sorted, the
longest common prefixes of neighbours give the tree's internal nodes, and each node as deep as a window holds the
copies of one repeated window; its smallest doc_id decides which of them are removed.

Defined results: null or blank text has no words; fewer than 13 words have no window; rows that share a doc_id are one
document with several texts, whose passages don't count against each other; so are all rows without doc_id, and that
document stands before every other; an empty table gives an empty table; extra columns play no part. Words are
compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import texts_of
from .repeats import HOT_WINDOWS, Group, Windows, covered, keyed, mask_of, with_spans
from .shared import frugal

WIDTH = 13
#: Suffixes whose subtree is built at once; a larger group is split by a longer prefix.
SUBTREE = 1 << 20


def _subtree(g: Group, of: Windows, which: np.ndarray, out: np.ndarray) -> None:
    """Sort the suffixes ``which``, find the nodes as deep as a window, write the smallest document of each into ``out``."""
    words = [g.x[g.pos[which] + i] for i in range(of.width)]
    group = [g.m[g.run[which]], g.back[which]]
    order = np.lexsort([*reversed(words), *reversed(group)])  # the last key leads: group, anchor's place, words from the first on
    common = np.ones(len(which) - 1, dtype=bool)
    for c in group:
        common &= c[order[1:]] == c[order[:-1]]
    prefixes = np.zeros(len(which) - 1, dtype=np.int64)  # words that neighbours share from the first on
    for c in words:
        common &= c[order[1:]] == c[order[:-1]]
        prefixes += common
    node = np.flatnonzero(np.append(True, prefixes < of.width))
    least = np.minimum.reduceat(g.d[g.run[which[order]]], node)
    out[which[order]] = np.repeat(least, np.diff(np.append(node, len(which))))


def subtrees(g: Group, of: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document in which each window starts; every window has one."""
    out = g.d[g.run].copy()
    which = np.arange(len(out))
    parts = [which] if len(which) <= SUBTREE else [np.flatnonzero(g.back == b) for b in np.unique(g.back)]
    for part in parts:
        if len(part) > 1:
            _subtree(g, of, part, out)
    return out, np.ones(len(out), dtype=bool)


def _windows(width: int) -> Windows:
    return Windows(width, min(3, width), True)


@frugal
def _cleaned(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        spans = batch.column("spans")
        n, removed, kept = [], [], []
        for r in range(batch.num_rows):
            words = data[offsets[r] : offsets[r + 1]].tobytes().split()  # on exactly 0x20 and 0x09-0x0D
            n.append(len(words))
            if spans[r].is_valid:
                gone = mask_of(spans, r, len(words), width)
                removed.append(int(gone.sum()))
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            else:
                removed.append(0)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("row").field("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


@frugal
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "n_words", "n_removed")] + [pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup(docs: DataFrame, width: int = WIDTH, hot: int = HOT_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (``kept``, binary) of every document."""
    base = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = covered(base, _windows(width), subtrees, False, hot)
    return with_spans(base, spans).mapInArrow(partial(_cleaned, width=width), "doc_id long, n_words long, n_removed long, kept binary")


def op5(docs: DataFrame) -> DataFrame:
    return dedup(docs).mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
