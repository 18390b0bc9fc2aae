"""Motifs: weight matrices from counts, k-mer scores on either strand, hits, significant patterns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kmer import ALPHABET, lattice, reverse_complement, windows

#: Pseudo-count of each letter and background chance of each (a GC content of 0.5).
PSEUDO, BACKGROUND = 1.0, 0.25
#: Longest motif whose k-mers are scored once and sent to all tasks (65,536 rows) instead of scoring every window.
LATTICE = 8


def pssm(counts: DataFrame, pseudo: float = PSEUDO, background: float = BACKGROUND) -> DataFrame:
    """(matrix_id, pos, base, p, score) from (matrix_id, pos, base, count): chance and log2 odds of each letter."""
    total = counts.groupBy("matrix_id", "pos").agg(F.sum(F.col("count") + pseudo).alias("total"))
    p = (F.col("count") + pseudo) / F.col("total")
    return counts.join(total, ["matrix_id", "pos"]).select("matrix_id", "pos", "base", p.alias("p"), F.log2(p / background).alias("score"))


def information(matrix: DataFrame, background: float = BACKGROUND) -> DataFrame:
    """(matrix_id, pos, ic, var): information content and variance of the letters' scores at each position, to 3 digits."""
    return matrix.groupBy("matrix_id", "pos").agg(F.bround(F.sum(F.col("p") * F.col("score")), 3).alias("ic"), F.bround(F.var_pop("score"), 3).alias("var"))


def override_counts(counts: DataFrame, pos: int, base: str, count: int | None = None) -> DataFrame:
    """The motif with one count changed; without ``count`` the letter becomes the consensus: it gets all sequences, the others 0."""
    here = F.col("pos") == pos
    n = counts.filter("pos = 0").groupBy("matrix_id").agg(F.sum("count").alias("_n"))
    if count is None:
        new = F.when(here, F.when(F.col("base") == base, F.col("_n")).otherwise(0)).otherwise(F.col("count"))
        name = F.concat("matrix_id", F.lit(f"_consensus__{pos}{base}"))
    else:
        new = F.when(here & (F.col("base") == base), count).otherwise(F.col("count"))
        name = F.concat("matrix_id", F.lit(f"__{base}{pos}_{count}"))
    return counts.join(n, "matrix_id").select(name.alias("matrix_id"), "pos", "base", new.cast("long").alias("count"))


def reverse_complement_counts(counts: DataFrame) -> DataFrame:
    last = counts.groupBy("matrix_id").agg(F.max("pos").alias("_last"))
    return counts.join(last, "matrix_id").select(F.concat("matrix_id", F.lit(".rc")).alias("matrix_id"), (F.col("_last") - F.col("pos")).alias("pos"), F.translate("base", "ACGT", "TGCA").alias("base"), "count")


def weights(matrix: DataFrame, matrix_id: str) -> list[dict[str, float]]:
    """The scores of one motif by position: a few rows, so they become literals of the plan."""
    rows = matrix.filter(F.col("matrix_id") == matrix_id).collect()
    out: list[dict[str, float]] = [{} for _ in range(max((r["pos"] for r in rows), default=-1) + 1)]
    for r in rows:
        out[r["pos"]][r["base"]] = r["score"]
    return out


def forward_score(kmer: Column, w: list[dict[str, float]]) -> Column:
    """Sum of the letters' scores."""
    total = F.lit(0.0)
    for i, letters in enumerate(w):
        at = F.substring(kmer, i + 1, 1)
        value = F.lit(None).cast("double")
        for base in ALPHABET:
            value = F.when(at == base, F.lit(letters[base])).otherwise(value)
        total = total + value
    return total


def score(kmer: Column, w: list[dict[str, float]], strand: str = "forward") -> Column:
    """Score on the ``forward`` or ``backward`` strand, or the better of both (``double``)."""
    if strand == "forward":
        return forward_score(kmer, w)
    back = forward_score(reverse_complement(kmer), w)
    if strand == "backward":
        return back
    if strand != "double":
        raise ValueError(f"strand is forward, backward or double, not {strand}")
    return F.greatest(forward_score(kmer, w), back)


def _scored_windows(each: DataFrame, w: list[dict[str, float]], threshold: float, strand: str) -> DataFrame:
    """``each`` with ``score``, where it is above ``threshold``."""
    m = len(w)
    if m > LATTICE:
        return each.withColumn("score", score(F.col("kmer"), w, strand)).filter(F.col("score") > threshold)
    # at most 4 ** LATTICE k-mers are scored once and come back as plain rows: as an expression the optimiser would
    # repeat their scores on the side of the windows
    good = lattice(each.sparkSession, m).select("kmer", score(F.col("kmer"), w, strand).alias("score")).filter(F.col("score") > threshold).collect()
    rows = each.sparkSession.createDataFrame([tuple(r) for r in good], "kmer string, score double")
    return each.join(F.broadcast(rows), "kmer").select(*each.columns, "score")


def hits(sequences: DataFrame, seq: str, w: list[dict[str, float]], threshold: float, strand: str = "double") -> DataFrame:
    """Windows that score above ``threshold``: the other columns, start, stop (from 1, inclusive), score, matched_sequence."""
    scored = _scored_windows(windows(sequences, seq, len(w)), w, threshold, strand)
    return scored.withColumnRenamed("pos", "start").withColumn("stop", F.col("start") + len(w) - 1).withColumnRenamed("kmer", "matched_sequence")


#: Scores are compared with their distribution as whole numbers of this size.
UNIT = 1e-6


def p_values(w: list[dict[str, float]]) -> list[tuple[int, float]]:
    """(score in units, chance of that score or more) of a k-mer under equal letter chances, best first.

    The exact distribution, by adding one position after another on the driver (one row for each possible score).
    """
    chances = {0: 1.0}
    for letters in w:
        new: dict[int, float] = {}
        for s, c in chances.items():
            for x in letters.values():
                at = s + round(x / UNIT)
                new[at] = new.get(at, 0.0) + c * BACKGROUND
        chances = new
    out, held = [], 0.0
    for s, c in sorted(chances.items(), reverse=True):
        held += c
        out.append((s, held))
    return out


def scan_hits(sequences: DataFrame, seq: str, w: list[dict[str, float]], p_value: float = 2e-3) -> DataFrame:
    """Hits on either strand with a chance of at most ``p_value``: the other columns, start, stop, strand, score, p_value,
    matched_sequence (read on its own strand). A window may be a hit on both strands.
    """
    table = [(s, p) for s, p in p_values(w) if p <= p_value * (1 + 1e-12)]
    units = [{b: float(round(x / UNIT)) for b, x in letters.items()} for letters in w]
    least = table[-1][0] if table else 1 << 60
    both = windows(sequences, seq, len(w)).withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    both = both.withColumn("kmer", F.when(F.col("strand") == "+", F.col("kmer")).otherwise(reverse_complement(F.col("kmer"))))
    found = _scored_windows(both, units, least - 0.5, "forward").withColumn("_s", F.col("score").cast("long"))
    tail = sequences.sparkSession.createDataFrame(table, "_s long, p_value double")
    found = found.join(F.broadcast(tail), "_s")  # a row for each possible score of a hit
    others = [c for c in sequences.columns if c != seq]
    return found.select(*others, F.col("pos").alias("start"), (F.col("pos") + len(w) - 1).alias("stop"), "strand", (F.col("_s") * UNIT).alias("score"), "p_value", F.col("kmer").alias("matched_sequence"))


def mean_and_std(w: list[dict[str, float]]) -> tuple[float, float]:
    """Mean and standard deviation of a k-mer's score under the motif's own letter chances (background times 2 ** score)."""
    mean = var = 0.0
    for letters in w:
        p = {b: BACKGROUND * 2**x for b, x in letters.items()}
        own = sum(p[b] * x for b, x in letters.items())
        mean += own
        var += sum(p[b] * (x - own) ** 2 for b, x in letters.items())
    return mean, math.sqrt(var)


def suffix_maxima(matrix: DataFrame) -> DataFrame:
    """(matrix_id, pos, best): the most that the letters from ``pos`` on can add, the bound of a branch-and-bound search."""
    best = matrix.groupBy("matrix_id", "pos").agg(F.max("score").alias("_m"))
    after = Window.partitionBy("matrix_id").orderBy(F.desc("pos"))
    return best.select("matrix_id", "pos", F.sum("_m").over(after).alias("best"))


def threshold_for(spark, w: list[dict[str, float]], p_value: float, strand: str = "forward") -> float:
    """The smallest score of a k-mer whose upper tail holds at most ``p_value`` of all k-mers; inf if none does."""
    m = len(w)
    tail = lattice(spark, m).select(score(F.col("kmer"), w, strand).alias("s")).groupBy("s").count().orderBy(F.desc("s")).limit(math.ceil(4**m * p_value) + 1).collect()
    held, best = 0, math.inf
    for r in tail:
        held += r["count"]
        if held > p_value * 4**m:
            break
        best = r["s"]
    return best


def significant_patterns(spark, w: list[dict[str, float]], threshold: float, strand: str = "forward") -> DataFrame:
    """(kmer, score) of the k-mers that reach the threshold, best first."""
    return lattice(spark, len(w)).select("kmer", score(F.col("kmer"), w, strand).alias("score")).filter(F.col("score") >= threshold).orderBy(F.desc("score"), "kmer")
