"""Operator 13, secret scans: fixed patterns, and a battery of randomness tests with a bounded share of false finds.

The patterns give the base spans. Beside them, every run of 16 or more letters, digits and ``+ / _ -`` (and trailing
``=``) that touches no base span is a candidate. Its encoding is the smallest alphabet that holds it. Three tests ask how
unlike a uniform choice from that alphabet it is: chi-squared over the letters' counts, the number of runs of character
classes (digits, capitals, the rest), and the correlation of neighbours. Each gives a two-sided chance; the least of them,
times three, is the candidate's: it is evenly spread for random keys and tiny for words, names and paths.

How tiny is learned from the corpus: runs of ordinary letters of the same document and length, with the candidates cut out,
pass through the same battery (all of them, side by side, for each document, encoding and length). By encoding and class of length, their
share at a candidate's chance or above is the chance that ordinary text looks so random, and a Benjamini-Hochberg step
over the class keeps the candidates among which at most 1 in 20 is expected to be ordinary, down to a chance of 10 ** -5.
Longer runs can be told apart better and so pass at smaller chances; a class whose ordinary text can't be told from keys
keeps nothing.

Texts are read once; counts by class come from all documents and are a few thousand rows. Digits alone are no candidate.

Defined results: null and empty texts have no spans; places are code points; texts of any length are scanned whole, and a
run of over 256 letters is compared with ordinary runs of 256; rows are judged one by one, so repeated rows and missing
doc_ids each have their result; where no ordinary text is there to compare with, nothing is added; an empty table gives an
empty table; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import frugal, scratch, written

# The patterns of the base spans and the least length of what must be in them.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, smallest alphabet first.
ENCODINGS = {
    "decimal": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "lower": _LOWER, "upper": _UPPER, "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_", "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}
_SETS = {name: frozenset(letters) for name, letters in ENCODINGS.items()}
_OUTSIDE = {name: re.compile(f"[^{re.escape(letters)}]+") for name, letters in ENCODINGS.items()}
#: Share of false finds, longest ordinary run, letters of ordinary runs that are tested at a time.
FALSE, LONGEST, AT_A_TIME = 0.05, 256, 1 << 20
#: Steps of the chance's logarithm in which it is counted, and their number: from 1 down to 10 ** -20.
STEPS, BINS = 20, 400
#: The last step that may be kept: a chance of 10 ** -5, below which a run is no uniform choice, whatever ordinary text does.
LEAST = 100


#: One of these is in every text that has a match of ``ASSIGN``, in lower case: a quick look before the pattern.
_STEMS = ("passw", "secret", "token", "api_key", "apikey")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind; matches of one kind don't overlap."""
    low = text.lower()
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST] if any(w in low for w in _STEMS) else []
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def encoding(token: str) -> str:
    """The smallest alphabet that holds the token."""
    letters = set(token)
    return next(name for name, known in _SETS.items() if letters <= known)


_CLASS = np.full(128, 2)
_CLASS[ord("0") : ord("9") + 1], _CLASS[ord("A") : ord("Z") + 1] = 0, 1
_PLACE = {name: np.full(128, -1) for name in ENCODINGS}
for _name, _letters in ENCODINGS.items():
    _PLACE[_name][np.frombuffer(_letters.encode(), dtype=np.uint8)] = np.arange(len(_letters))
_two_sided = np.vectorize(lambda z: math.erfc(abs(z) / math.sqrt(2)), otypes=[float])


def chances(tokens: list[str], name: str) -> np.ndarray:
    """For tokens of one length, how likely a uniform choice from the encoding's alphabet is as uneven, as rich or poor in
    runs, or as correlated as each."""
    k, n, rows = len(ENCODINGS[name]), len(tokens[0]), len(tokens)
    codes = np.frombuffer("".join(tokens).encode(), dtype=np.uint8).reshape(rows, n)
    x = _PLACE[name][codes]
    # chi-squared: its mean and variance for n letters are exact, the cube root makes it nearly normal
    counts = np.bincount((x + k * np.arange(rows)[:, None]).ravel(), minlength=rows * k).reshape(rows, k)
    chi = ((counts - n / k) ** 2).sum(axis=1) * k / n
    mean, var = k - 1, 2 * (k - 1) * (1 - 1 / n)
    off = 2 / (9 * (2 * mean * mean / var))
    z = [((chi / mean) ** (1 / 3) - (1 - off)) / math.sqrt(off)]
    # runs of classes: changes between neighbours, of which those that share a letter depend on each other
    kind = _CLASS[codes]
    share = np.bincount(_CLASS[np.frombuffer(ENCODINGS[name].encode(), dtype=np.uint8)], minlength=3) / k
    change = 1 - float((share**2).sum())
    if change > 0:
        both = 1 - 2 * float((share**2).sum()) + float((share**3).sum())
        spread = (n - 1) * change * (1 - change) + 2 * (n - 2) * (both - change * change)
        z.append(((kind[:, 1:] != kind[:, :-1]).sum(axis=1) - (n - 1) * change) / math.sqrt(max(spread, 1e-9)))
    # serial correlation of neighbours
    centred = x - x.mean(axis=1, keepdims=True)
    power = (centred**2).sum(axis=1)
    r = np.where(power > 0, (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.where(power > 0, power, 1), 1.0)
    z.append((r + 1 / n) * math.sqrt(n))
    return np.minimum(1.0, _two_sided(np.stack(z)).min(axis=0) * len(z))


def _bin(p: float) -> int:
    return min(BINS, int(-math.log10(p) * STEPS)) if p > 0 else BINS


def _length_class(n: int) -> int:
    """16 to 31 letters, 32 to 63, and so on; 256 and more are one."""
    return min(n, LONGEST).bit_length()


def ordinary_bins(letters: str, name: str, size: int) -> Counter[int]:
    """How many of the runs of ``size`` letters fall into each bin: all that stand side by side, and one up to the end."""
    starts = [*range(0, len(letters) - size + 1, size)]
    if len(letters) > size and len(letters) % size:
        starts.append(len(letters) - size)
    n, step = Counter(), max(1, AT_A_TIME // size)
    for i in range(0, len(starts), step):
        n.update(map(_bin, chances([letters[s : s + size] for s in starts[i : i + step]], name)))
    return n


def candidates(text: str, base: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int, str, int, int]], list[tuple[str, int, int, int]]]:
    """(start, end, encoding, length class, bin) of each candidate, and (encoding, length class, bin, number) of the
    ordinary runs of the candidates' encodings and lengths: all of the text."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    if not runs:
        return [], []
    covered = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in covered], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in covered], dtype=np.int64)) if covered else starts
    found = []
    for s, e in runs:
        at = int(np.searchsorted(starts, e))  # base spans that start before the run's end
        if at and reach[at - 1] > s:
            continue
        token = text[s:e].rstrip("=")
        if (name := encoding(token)) != "decimal":
            found.append((s, e, name, _length_class(len(token)), _bin(chances([token], name)[0])))
    if not found:
        return [], []
    parts, at = [], 0  # the text without candidates and base spans
    for s, e in sorted([*runs, *covered]):
        parts.append(text[at:s])
        at = max(at, e)
    rest = " ".join([*parts, text[at:]])
    ordinary = []
    for name, size in sorted({(f[2], min(len(text[f[0] : f[1]].rstrip("=")), LONGEST)) for f in found}):
        letters = _OUTSIDE[name].sub("", rest if _SETS[name] & _SETS["lower"] else rest.upper())
        ordinary += [(name, _length_class(size), at, n) for at, n in sorted(ordinary_bins(letters, name, size).items())]
    return found, ordinary


_SPAN = "array<struct<kind: string, start: long, end: long>>"
_FOUND = f"doc_id long, base {_SPAN}, found array<struct<start: long, end: long, encoding: string, length: int, bin: int>>, ordinary array<struct<encoding: string, length: int, bin: int, n: long>>"


@frugal
def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length", pa.int32()), ("bin", pa.int32())]))
    plain = pa.list_(pa.struct([("encoding", pa.string()), ("length", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))
    for b in batches:
        base, found, ordinary = [], [], []
        for text in b.column("text"):
            t = text.as_py() or ""
            own = base_spans(t)
            runs, others = candidates(t, own)
            base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in own])
            found.append([dict(zip(("start", "end", "encoding", "length", "bin"), x, strict=True)) for x in runs])
            ordinary.append([dict(zip(("encoding", "length", "bin", "n"), x, strict=True)) for x in others])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, span), pa.array(found, run), pa.array(ordinary, plain)], names=["doc_id", "base", "found", "ordinary"])


def limits(scanned: DataFrame, false: float = FALSE) -> DataFrame:
    """(encoding, length, bin): the last bin of each class that is kept. A few rows for each class, counted before a shuffle."""
    of = lambda c: scanned.select(F.explode(c).alias("x")).groupBy("x.encoding", "x.length", "x.bin")
    counts = of("found").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("o")).union(of("ordinary").agg(F.lit(0).cast("long"), F.sum("x.n")))
    counts = counts.groupBy("encoding", "length", "bin").agg(F.sum("n").alias("n"), F.sum("o").alias("o"))
    own = Window.partitionBy("encoding", "length")
    to_here = own.orderBy("bin")
    looks = (F.sum("o").over(to_here) + 1) / (F.sum("o").over(own) + 1)
    ok = (looks * F.sum("n").over(own) <= F.lit(false) * F.sum("n").over(to_here)) & (F.col("bin") <= LEAST)
    return counts.withColumn("ok", ok).filter("ok").groupBy("encoding", "length").agg(F.max("bin").alias("bin"))


@frugal
def _written_out(batches: Iterator[pa.RecordBatch], least: dict[tuple[str, int], int]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate(KINDS)}
    line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]])))
    for b in batches:
        n, digests, lines = {k: [] for k in KINDS}, [], []
        for base, found in zip(b.column("base").to_pylist(), b.column("found").to_pylist(), strict=True):
            own = [(x["kind"], x["start"], x["end"]) for x in base]
            more = [("random", x["start"], x["end"]) for x in found if x["bin"] <= least.get((x["encoding"], x["length"]), -1)]
            for k in KINDS:
                n[k].append(sum(x[0] == k for x in own) if k != "random" else len(more))
            digests.append(hashlib.sha256(line(own).encode()).hexdigest())
            lines.append(line(own + more))
        counts = [pa.array(n[k], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(lines, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def secret_spans(docs: DataFrame, false: float = FALSE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        scanned = keep(written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scanned, _FOUND), "scanned"))
        least = {(r["encoding"], r["length"]): r["bin"] for r in limits(scanned, false).collect()}  # one row a class: at most 12 x 5
    return scanned.select("doc_id", "base", "found").mapInArrow(partial(_written_out, least=least), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def op13(docs: DataFrame) -> DataFrame:
    return secret_spans(docs)
