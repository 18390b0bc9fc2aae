"""Coding regions of whole texts: what one pass over them draws, batch by batch and before any shuffle.

A text's letters are those of ``kmer.dna``. Its coding region goes from its first start codon to the first stop codon in
that frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import kmer
from .cost import START, STOPS


def _code(word: str) -> int:
    return sum(kmer.ALPHABET.index(x) * 4**i for i, x in enumerate(reversed(word)))


def _earliest(held: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
    """Each row's first place (both in order) is held, unless the row has one."""
    lead = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    lead = lead[held[row[lead]] < 0]
    held[row[lead]] = place[lead]


def _found(letters: np.ndarray, at: np.ndarray, each: Callable[[np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, length) of the coding regions in ``kmer.places``; ``each`` is given the codes of all windows of three letters."""
    first, stop = np.full(len(at) - 1, -1), np.full(len(at) - 1, -1)
    for a, code, holds in kmer.stretches(letters, at, 3):
        if each:
            each(code[holds])
        # only start and stop codons get their row
        i = a + np.flatnonzero((code == _code(START)) & holds)
        row = np.searchsorted(at, i, "right") - 1
        _earliest(first, row, i - at[row])
        i = a + np.flatnonzero(np.logical_or.reduce([code == _code(c) for c in STOPS]) & holds)
        row = np.searchsorted(at, i, "right") - 1
        place = i - at[row]
        after = place - first[row]
        held = (first[row] >= 0) & (after > 0) & (after % 3 == 0)
        _earliest(stop, row[held], place[held])
    row = np.flatnonzero(stop >= 0)
    return row, at[row] + first[row], stop[row] + 3 - first[row]


def _spread(start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the region, position from 0, place among all letters) of the letters of regions, some ``LETTERS`` at a time."""
    at = np.r_[0, np.cumsum(length)]
    for a in range(0, int(at[-1]), kmer.LETTERS):
        z = min(a + kmer.LETTERS, int(at[-1]))
        r0, r1 = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, z))
        own = np.repeat(np.arange(r0, r1), np.diff(np.clip(at[r0 : r1 + 1], a, z)))
        pos = np.arange(a, z) - at[own]
        yield own, pos, start[own] + pos


def _regions(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    alphabet = np.frombuffer(kmer.ALPHABET.encode(), dtype=np.uint8)
    for b in batches:
        if not b.num_rows:
            continue
        letters, at = kmer.places(b.column(text), text=True)
        row, start, length = _found(letters, at)
        data = np.concatenate([np.zeros(0, dtype=np.uint8), *(alphabet[letters[i]] for _, _, i in _spread(start, length))])
        seq = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
        others = [c for c in b.schema.names if c != text]
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in others), seq], names=[*others, "seq"])


def regions(df: DataFrame, text: str) -> DataFrame:
    """The other columns and ``seq`` of every text that has a coding region."""
    kept = [f for f in df.schema.fields if f.name != text]
    return df.mapInArrow(partial(_regions, text=text), StructType([*kept, StructField("seq", StringType())]))


_DRAWN = "what string, pos long, code long, n long"


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("key").dictionary_encode("encode")
        letters, at = kmer.places(b.column("text"), text=True)
        triples = kmer.Tally(64)
        row, start, length = _found(letters, at, triples.add)
        key, longest = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row], int(length.max(initial=0))
        regions, bases = kmer.Tally(len(keys.dictionary)), kmer.Tally(len(keys.dictionary) * longest * 4)
        regions.add(key)
        for own, pos, i in _spread(start, length):
            bases.add((key[own] * longest + pos) * 4 + letters[i])
        for what, tally, span in (("kmer", triples, 64), ("region", regions, 1), ("letter", bases, longest * 4)):
            for value, n in tally.pieces():
                if len(value):
                    own = keys.dictionary.take(pa.array(value // span)) if what != "kmer" else pa.nulls(len(value), keys.dictionary.type)
                    pos, code = (value % span // 4, value % 4) if what == "letter" else (np.zeros_like(value), value % span)
                    yield pa.RecordBatch.from_arrays([own, pa.array([what] * len(value)), pa.array(pos), pa.array(code), pa.array(n.astype(np.int64))], names=["key", "what", "pos", "code", "n"])


def drawn(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, what, pos, code, n) of one pass over the texts: how often each three-letter code stands in all of them (what:
    kmer, key null), how many coding regions a key has (region), and the letters at each position of them, from 0 (letter)."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(_drawn, f"key {rows.schema['key'].dataType.simpleString()}, {_DRAWN}")
    return found.groupBy("key", "what", "pos", "code").agg(F.sum("n").alias("n"))


def triples(found: DataFrame) -> DataFrame:
    """(kmer, n) of ``drawn``."""
    return found.filter("what = 'kmer'").select(kmer.kmer(F.col("code"), 3).alias("kmer"), "n")


def consensus(found: DataFrame, key: str, seq: str, reached: tuple[int, int]) -> DataFrame:
    """(key, seq) of ``drawn``: ``kmer.consensus`` of its coding regions."""
    base = F.substring(F.lit(kmer.ALPHABET), (F.col("code") + 1).cast("int"), F.lit(1))
    letters = found.filter("what = 'letter'").select(F.col("key").alias(key), "pos", base.alias("base"), "n")
    return kmer.consensus_of(letters, found.filter("what = 'region'").select(F.col("key").alias(key), "n"), key, seq, reached)
