"""Bases, k-mers, windows and the De Bruijn machine as relations. A k-mer's code is its base-4 number (A C G T)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ACGT"


def dna(text: Column) -> Column:
    """The letters A, C, G, T of a text, upper-cased. Only these are: some others would become one of them and a sign."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]+", ""))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def code(kmer: Column, m: int) -> Column:
    """Base-4 number of a k-mer."""
    digits = F.translate(kmer, ALPHABET, "0123")
    return F.conv(digits, 4, 10).cast("long") if m else F.lit(0).cast("long")


def kmer(value: Column, m: int) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), m, "0"), "0123", ALPHABET)


def lattice(spark: SparkSession, m: int) -> DataFrame:
    """All k-mers of length m: (v, kmer)."""
    return spark.range(4**m).select(F.col("id").alias("v"), kmer(F.col("id"), m).alias("kmer"))


def transitions(spark: SparkSession, m: int) -> DataFrame:
    """The De Bruijn machine: (u, sigma, v), v being u without its first letter and with sigma at the end."""
    return spark.range(4**m).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("sigma")).withColumn("v", F.pmod(F.col("u") * 4 + F.col("sigma"), F.lit(4**m)))


#: Letters that a row carries while its windows are taken.
PIECE = 64


def windows(df: DataFrame, seq: str, m: int) -> DataFrame:
    """One row for each window of m letters: the other columns, ``pos`` (from 1) and ``kmer``. Linear in a text's length.

    One pass cuts a text into pieces that overlap by m - 1 letters, so no window walks through the whole text.
    """
    others = [c for c in df.columns if c != seq]
    cut = f"(?s)(?=(.{{1,{PIECE + m - 1}}})).{{1,{PIECE}}}"
    pieces = df.select(*others, F.posexplode(F.regexp_extract_all(F.col(seq), F.lit(cut), F.lit(1))).alias("_i", "_piece"))
    n = F.length("_piece")
    inside = F.when(n >= m, F.transform(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda p: F.substring(F.col("_piece"), p, F.lit(m))))
    each = pieces.select(*others, "_i", F.posexplode(inside).alias("_p", "kmer"))
    return each.select(*others, (F.col("_i") * PIECE + F.col("_p") + 1).alias("pos"), "kmer")


#: Letters that are counted at a time, and numbers of k-mers and keys that are counted in a whole array.
LETTERS, BINS = 1 << 20, 1 << 22
_PLACE = np.full(256, 4, dtype=np.uint8)
_PLACE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = range(4)
#: The same with lower-case letters. No other character becomes one of the four in upper case by itself.
_ANY_CASE = _PLACE.copy()
_ANY_CASE[np.frombuffer(ALPHABET.lower().encode(), dtype=np.uint8)] = range(4)
_TABLES = {False: _PLACE.tobytes(), True: _ANY_CASE.tobytes()}


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, at): text i has the bytes from at[i] to at[i + 1]; none if null."""
    texts = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8), at


def places(column: pa.Array, text: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(letters, at): sequence i has the letters from at[i] to at[i + 1], as 0 to 3, any other byte as 4.

    With ``text`` the letters are those of ``dna``: lower-case ones too, and all other characters are left out.
    """
    data, at = _buffers(column)
    kept, starts, n = [np.zeros(0, dtype=np.uint8)], np.zeros(len(at), dtype=np.int64), 0
    for a in range(int(at[0]), int(at[-1]), LETTERS):
        z = min(a + LETTERS, int(at[-1]))
        letters = np.frombuffer(data[a:z].tobytes().translate(_TABLES[text]), dtype=np.uint8)
        if text:
            found = np.flatnonzero(letters < 4)
            letters = letters[found]
            i, j = np.searchsorted(at, [a, z])
            starts[i:j] = n + np.searchsorted(found, at[i:j] - a)
        kept.append(letters)
        n += len(letters)
    if text:
        starts[np.searchsorted(at, at[-1]) :] = n
    return np.concatenate(kept), starts if text else at - at[0]


def stretches(letters: np.ndarray, at: np.ndarray, m: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first place, codes, which hold) of the windows that begin at successive letters of ``places``, some ``LETTERS`` at a
    time. A window holds if it ends in its own sequence and has no other letters. Codes are the smallest numbers that fit."""
    kind = np.min_scalar_type(4**m - 1) if m <= 16 else np.int64
    plain = not (letters > 3).any()
    for a in range(0, len(letters) - m + 1, LETTERS):
        z = min(a + LETTERS, len(letters) - m + 1)
        value, holds = np.zeros(z - a, dtype=kind), np.ones(z - a, dtype=bool)
        for i in range(m):
            value *= 4
            value += letters[a + i : z + i]
            if not plain:
                holds &= letters[a + i : z + i] < 4
        ends = at[np.searchsorted(at, a, "right") : np.searchsorted(at, z + m - 1)]
        for i in range(1, m):
            over = ends - i - a
            holds[over[(over >= 0) & (over < z - a)]] = False
        yield a, value, holds


def codes(letters: np.ndarray, at: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place from 0, code) of each window of m letters A, C, G, T of ``places``, in order, some ``LETTERS`` at a time."""
    for a, value, holds in stretches(letters, at, m):
        z = a + len(value)
        r0, r1 = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, z))
        row = np.repeat(np.arange(r0, r1), np.diff(np.clip(at[r0 : r1 + 1], a, z)))
        yield row[holds], (np.arange(a, z) - at[row])[holds], value[holds].astype(np.int64)


class Tally:
    """Counts of small whole numbers below ``size``: in a whole array if it is small, else piece by piece."""

    def __init__(self, size: int) -> None:
        self.size, self.whole, self.found = size, np.zeros(size if size <= BINS else 0, dtype=np.int64), []

    def add(self, values: np.ndarray) -> None:
        if self.size <= BINS:
            self.whole += np.bincount(values, minlength=self.size)
        else:
            self.found.append(np.unique(values.astype(np.int64), return_counts=True))

    def pieces(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(values, how often), a value in several pieces if the array is large."""
        return [(np.flatnonzero(self.whole), self.whole[self.whole > 0])] if self.size <= BINS else self.found


def _counted(batches: Iterator[pa.RecordBatch], m: int, text: bool = False) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("key").dictionary_encode("encode")
        own, tally = keys.indices.to_numpy(zero_copy_only=False), Tally(len(keys.dictionary) * 4**m)
        for row, _, value in codes(*places(b.column("seq"), text), m):
            tally.add(own[row] * 4**m + value)
        for both, n in tally.pieces():
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(both // 4**m)), pa.array(both % 4**m), pa.array(n.astype(np.int64))], names=["key", "code", "n"])


def counts(df: DataFrame, seq: str, m: int, key: str | None = None, text: bool = False) -> DataFrame:
    """(key, kmer, n), or (kmer, n): how often each k-mer of m letters A, C, G, T stands in all sequences of a key. Counted
    batch by batch before any shuffle, so no window becomes a row. With ``text`` the sequences are the ``dna`` of texts."""
    rows = df.select((F.col(key) if key else F.lit("")).alias("key"), F.col(seq).alias("seq"))
    found = rows.mapInArrow(partial(_counted, m=m, text=text), f"key {rows.schema['key'].dataType.simpleString()}, code long, n long")
    each = found.groupBy("key", "code").agg(F.sum("n").alias("n"))
    return each.select(*([F.col("key").alias(key)] if key else []), kmer(F.col("code"), m).alias("kmer"), "n")


def pattern_hits(df: DataFrame, seq: str, patterns: list[str]) -> DataFrame:
    """(other columns, pattern, start, stop from 1) of every occurrence of patterns of any lengths, overlaps included.

    Patterns are grouped by length: the windows of a length are joined with its patterns, so none is tried at every place.
    """
    others = [c for c in df.columns if c != seq]
    out = None
    for m in sorted({len(p) for p in patterns if p}):
        rows = df.sparkSession.createDataFrame([(p,) for p in sorted(set(patterns)) if len(p) == m], "kmer string")
        found = windows(df, seq, m).join(F.broadcast(rows), "kmer").select(*others, F.col("kmer").alias("pattern"), F.col("pos").alias("start"), (F.col("pos") + m - 1).alias("stop"))
        out = found if out is None else out.union(found)
    return out if out is not None else df.limit(0).select(*others, F.col(seq).alias("pattern"), F.lit(1).alias("start"), F.lit(1).alias("stop"))


def strand_of(name: Column) -> Column:
    """+ or - from the number between underscores in a file's name (1: +), Unknown without one."""
    found = F.regexp_extract(name, "_(-?\\d)_", 1)
    return F.when(found == "", "Unknown").when(found == "1", "+").otherwise("-")


def base_frequencies(df: DataFrame, seq: str) -> DataFrame:
    """Share of each letter at each position over all sequences: (pos, base, n, freq)."""
    each = df.select(F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("p", "base")).select((F.col("p") + 1).cast("int").alias("pos"), "base")
    n = each.groupBy("pos", "base").agg(F.count("*").alias("n"))
    total = n.groupBy("pos").agg(F.sum("n").alias("total"))
    return n.join(total, "pos").select("pos", "base", "n", (F.col("n") / F.col("total")).alias("freq"))


def consensus(df: DataFrame, key: str, seq: str, reached: tuple[int, int] = (1, 2)) -> DataFrame:
    """(key, seq): the most frequent letter at each position of a key's sequences (ties: the first letter in order), over
    the positions that at least ``reached[0]`` in ``reached[1]`` of them reach."""
    n = df.filter(F.col(seq) != "").groupBy(key).agg(F.count("*").alias("n"))
    each = df.select(key, F.posexplode(F.filter(F.split(seq, ""), lambda c: c != "")).alias("pos", "base")).groupBy(key, "pos", "base").agg(F.count("*").alias("n"))
    return consensus_of(each, n, key, seq, reached)


def consensus_of(letters: DataFrame, sequences: DataFrame, key: str, seq: str, reached: tuple[int, int] = (1, 2)) -> DataFrame:
    """The same from counts: ``letters`` (key, pos, base, n) and ``sequences`` (key, n), those that are not empty."""
    best = letters.groupBy(key, "pos").agg(F.min_by("base", F.struct(-F.col("n"), "base")).alias("base"), F.sum("n").alias("_reach"))
    kept = best.join(sequences.select(key, F.col("n").alias("_all")), key).filter(F.col("_reach") * reached[1] >= F.col("_all") * reached[0])
    letters = F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"])
    return kept.groupBy(key).agg(F.array_join(letters, "").alias(seq))


def sequence_diff(df: DataFrame, a: str, b: str) -> DataFrame:
    """Positions (from 1) where two columns of equal length differ; a length mismatch is one row with pos null."""
    others = [c for c in df.columns if c not in (a, b)]
    pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    same = df.filter(F.length(a) == F.length(b)).select(*others, F.posexplode(pairs).alias("p", "z")).filter("z.x <> z.y").select(*others, (F.col("p") + 1).cast("int").alias("pos"), F.col("z.x").alias("from_base"), F.col("z.y").alias("to_base"))
    return same.union(df.filter(F.length(a) != F.length(b)).select(*others, F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")))


def longest_common_prefix(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
