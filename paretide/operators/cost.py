"""Substitution costs: exact match, non-coding, codon-aware; coding positions of a marked sequence."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import sized, staged

# The standard genetic code, amino acids in the order TTT, TTC, TTA, TTG, TCT, ... (letters T, C, A, G).
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMINO_ACIDS = {a + b + c: _CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
STOPS = sorted(c for c, a in AMINO_ACIDS.items() if a == "*")
START, MARKER = "ATG", "*"
PURINES, PYRIMIDINES = "AG", "CT"


def amino_acid(codon: Column) -> Column:
    """One letter for each codon, * for a stop."""
    return F.substring(F.lit(_CODE), F.conv(F.translate(codon, "TCAG", "0123"), 4, 10).cast("int") + 1, F.lit(1))


def exact_match_cost(target: Column, sigma: Column) -> Column:
    return F.when(target == sigma, 0.0).otherwise(1.0)


def is_transition(a: Column, b: Column) -> Column:
    """Both purines or both pyrimidines, and different."""
    return (a != b) & ((a.isin(*PURINES) & b.isin(*PURINES)) | (a.isin(*PYRIMIDINES) & b.isin(*PYRIMIDINES)))


def noncoding_cost(target: Column, sigma: Column, alpha: float, beta: float) -> Column:
    return F.when(target == sigma, 0.0).when(is_transition(target, sigma), alpha).otherwise(beta)


def hamming(a: Column, b: Column, n: int = 3) -> Column:
    return sum((F.when(F.substring(a, i, 1) != F.substring(b, i, 1), 1.0).otherwise(0.0) for i in range(1, n + 1)), F.lit(0.0))


def coding_cost(proposed: Column, target: Column, start: Column, usage_cost: Column, w: float) -> Column:
    """Cost of the codon ``proposed`` in place of ``target``; the order of the cases matters."""
    a, b = amino_acid(proposed), amino_acid(target)
    return F.when(proposed == target, 0.0).when(a == b, usage_cost).when(start | (a == "*") | (b == "*"), float("inf")).otherwise(F.lit(w) + hamming(target, proposed))


def usage_costs(usage: DataFrame) -> DataFrame:
    """(codon, cost): ln(freq) over ln of the smallest frequency. Frequencies must lie in (0, 1)."""
    least = usage.agg(F.min("freq").alias("least"))
    ok = F.when((F.col("freq") > 0) & (F.col("freq") < 1), F.log("freq") / F.log("least"))
    return usage.crossJoin(F.broadcast(least)).select("codon", F.coalesce(ok, F.raise_error(F.concat(F.lit("frequency outside (0, 1): "), "codon")).cast("double")).alias("cost"))


def coding_positions(marked: Column) -> Column:
    """Struct (sequence, first, last, error) of a sequence whose coding region starts after a ``*``: positions from 1."""
    at = F.instr(marked, MARKER)
    seq = F.regexp_replace(marked, "\\*", "")
    marks = F.length(marked) - F.length(seq)
    codons = F.regexp_extract_all(F.substring(seq, at, F.length(seq)), F.lit("(?s).{3}"), F.lit(0))
    stop = F.nullif(F.array_position(F.transform(codons, lambda c, i: (i >= 1) & c.isin(*STOPS)), F.lit(True)), F.lit(0)) - 1
    error = F.when(marks > 1, "more than one marker").when((marks == 1) & (F.substring(seq, at, F.lit(3)) != START), "no start codon").when((marks == 1) & stop.isNull(), "no stop codon")
    found = (marks == 1) & error.isNull()
    return F.struct(seq.alias("sequence"), F.when(found, at).alias("first"), F.when(found, at + 3 * stop + 2).alias("last"), error.alias("error"))


def codon_position(pos: Column, first: Column, last: Column) -> Column:
    """0 outside the coding region, else 1, 2, 3 in the codon, -3 for the third of the start codon. All from 1."""
    inside = F.coalesce(pos.between(first, last), F.lit(False))
    return F.when(~inside, 0).when(pos == first + 2, -3).otherwise(F.pmod(pos - first, F.lit(3)) + 1).cast("int")


def python_positions(marked: str) -> tuple[str, list[int]]:
    """The same on the driver, for a single target; raises on a bad coding region."""
    at = marked.find(MARKER)
    if at < 0:
        return marked, [0] * len(marked)
    seq = marked[:at] + marked[at + 1 :]
    if MARKER in seq:
        raise ValueError("more than one marker")
    if seq[at : at + 3] != START:
        raise ValueError("no start codon")
    stop = next((i for i in range(at + 3, len(seq) - 2, 3) if seq[i : i + 3] in STOPS), None)
    if stop is None:
        raise ValueError("no stop codon")
    return seq, [0 if not at <= i < stop + 3 else (-3 if i == at + 2 else (i - at) % 3 + 1) for i in range(len(seq))]


def cost_table(marked: str, usage: dict[str, float] | None, alpha: float = 0.5, beta: float = 1.0, w: float = 500.0) -> list[tuple[int, str, str, float]]:
    """(i from 1, previous two letters, letter, cost) for every position: the finite domain of a job's costs.

    Without ``usage`` costs are those of exact match; the marker is taken out first in both cases.
    """
    seq, pos = python_positions(marked)
    out = []
    for i, p in enumerate(pos):
        for ctx in (a + b for a in "ACGT" for b in "ACGT"):
            for s in "ACGT":
                if usage is None:
                    c = 0.0 if seq[i] == s else 1.0
                elif p == 0:
                    pair = {seq[i], s}
                    c = 0.0 if seq[i] == s else alpha if pair <= set(PURINES) or pair <= set(PYRIMIDINES) else beta
                elif p in (1, 2):
                    c = 0.0
                else:
                    new, old = ctx + s, seq[i - 2 : i + 1]
                    if new == old:
                        c = 0.0
                    elif AMINO_ACIDS[new] == AMINO_ACIDS[old]:
                        c = usage[new]
                    elif p == -3 or "*" in (AMINO_ACIDS[new], AMINO_ACIDS[old]):
                        c = math.inf
                    else:
                        c = w + sum(x != y for x, y in zip(new, old, strict=True))
                out.append((i + 1, ctx, s, c))
    return out


@dataclass
class Place:
    """What a cost may depend on at a position: the target's letter, its place in a codon (as ``codon_position``), the
    target's codon that ends there, the two letters before the proposed one, and this."""

    target: Column
    position: Column
    codon: Column
    context: Column
    sigma: Column


#: Cost functions by name: expressions of a place and of the function's own parameters.
COSTS: dict[str, Callable[..., Column]] = {}


def cost_function(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    """Registers a cost function; costs of a table of targets and designs find it by its name."""

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        COSTS[name] = f
        return f

    return add


@cost_function("exact")
def exact_costs(at: Place) -> Column:
    return exact_match_cost(at.target, at.sigma)


@cost_function("codons")
def codon_costs(at: Place, usage: Column, alpha: float = 0.5, beta: float = 1.0, w: float = 500.0) -> Column:
    """Transitions and transversions outside the coding region; inside, a codon is judged at its third letter."""
    new = F.concat(at.context, at.sigma)
    third = coding_cost(new, at.codon, at.position == -3, F.element_at(usage, new), w)
    return F.when(at.position == 0, noncoding_cost(at.target, at.sigma, alpha, beta)).when(at.position.isin(1, 2), 0.0).otherwise(third)


def usage_map(usage: DataFrame) -> Column:
    """(codon, cost) as one map: at most 64 entries."""
    rows = usage.select("codon", "cost").limit(64).collect()
    return F.create_map(*[F.lit(x) for r in rows for x in (r["codon"], float(r["cost"]))])


def targets(marked: DataFrame, seq: str = "seq") -> DataFrame:
    """``marked`` with a sequence whose coding region follows a ``*`` in place of ``seq``, and its ``first`` and ``last``
    position (null without a mark). A bad coding region is an error."""
    found = coding_positions(F.col(seq))
    fault = F.when(found["error"].isNotNull(), F.raise_error(found["error"]).cast("string"))
    return marked.withColumn("_found", found).withColumn(seq, F.coalesce(fault, F.col("_found.sequence"))).withColumn("first", F.col("_found.first").cast("int")).withColumn("last", F.col("_found.last").cast("int")).drop("_found")


def place(padded: Column, at: Column, position: Column, context: Column, sigma: Column) -> Place:
    """The place at letter ``at`` (from 1) of a target that has two letters put before it."""
    return Place(F.substring(padded, at + 2, F.lit(1)), position, F.substring(padded, at, F.lit(3)), context, sigma)


def target_costs(rows: DataFrame, name: str, seq: str = "seq", **params: object) -> DataFrame:
    """The other columns, i, ctx, sigma, cost of every position of every target (seq, first, last), for every context and
    letter: the whole finite domain of a cost function, 64 rows a position."""
    others = [c for c in rows.columns if c not in (seq, "first", "last")]
    return _costs(_places(rows, seq), name, params).select(*others, "i", "ctx", "sigma", "cost")


def _places(rows: DataFrame, seq: str) -> DataFrame:
    """The other columns, i, and what a cost may depend on at that position: _p and _near."""
    others = [c for c in rows.columns if c not in (seq, "first", "last")]
    each = rows.filter(F.length(seq) > 0).withColumn("_padded", F.concat(F.lit("AA"), seq)).withColumn("i", F.explode(F.sequence(F.lit(1), F.length(seq))))
    return each.select(*others, "i", codon_position(F.col("i"), F.col("first"), F.col("last")).alias("_p"), F.substring("_padded", F.col("i"), F.lit(3)).alias("_near"))


def _costs(places: DataFrame, name: str, params: dict[str, object]) -> DataFrame:
    """``places`` with ctx, sigma and cost: 64 rows each."""
    pairs = [a + b for a in "ACGT" for b in "ACGT"]
    each = places.withColumn("ctx", F.explode(F.array(*map(F.lit, pairs)))).withColumn("sigma", F.explode(F.array(*map(F.lit, "ACGT"))))
    here = Place(F.substring("_near", 3, 1), F.col("_p"), F.col("_near"), F.col("ctx"), F.col("sigma"))
    return each.withColumn("cost", COSTS[name](here, **params).cast("double"))


def cost_totals(rows: DataFrame, name: str, seq: str = "seq", **params: object) -> DataFrame:
    """The other columns, sigma, n, n_forbidden, total, most: the costs of ``target_costs`` by target and letter, the sum and
    the largest of finite ones.

    A position's costs depend on its place in a codon and the three letters there, so they are formed once for each such
    place that occurs (a few hundred), and a target only counts its places.
    """
    others = [c for c in rows.columns if c not in (seq, "first", "last")]
    places = _places(rows, seq)
    finite = F.when(F.col("cost") < float("inf"), F.col("cost"))
    each = _costs(places.select("_p", "_near").distinct(), name, params).groupBy("_p", "_near", "sigma")
    each = each.agg(F.count("*").alias("n"), F.count_if(F.col("cost") == float("inf")).alias("n_forbidden"), F.sum(finite).alias("total"), F.max(finite).alias("most"))
    wide = each.groupBy("_p", "_near").agg(F.collect_list(F.struct("sigma", "n", "n_forbidden", "total", "most")).alias("_each"))
    of = lambda c, s: F.filter("_each", lambda x: x["sigma"] == s)[0][c]
    known = staged(wide.select("_p", "_near", *[of(c, s).alias(f"{c}_{s}") for s in "ACGT" for c in ("n", "n_forbidden", "total", "most")]), "places")
    sums = [f(f"{c}_{s}").alias(f"{c}_{s}") for s in "ACGT" for c, f in (("n", F.sum), ("n_forbidden", F.sum), ("total", F.sum), ("most", F.max))]
    out = places.join(sized(known), ["_p", "_near"]).groupBy(*others).agg(*sums)
    letters = F.array(*[F.struct(F.lit(s).alias("sigma"), *[F.col(f"{c}_{s}").alias(c) for c in ("n", "n_forbidden", "total", "most")]) for s in "ACGT"])
    return out.select(*others, F.explode(letters).alias("x")).select(*others, "x.*")


def max_cost(alpha: float, beta: float, w: float) -> float:
    """A bound of all finite costs."""
    return max(alpha, beta, w + 3)


def costs_frame(spark: SparkSession, jobs: dict[str, list[tuple[int, str, str, float]]]) -> DataFrame:
    return spark.createDataFrame([(j, *row) for j, rows in jobs.items() for row in rows], "job string, i int, ctx string, sigma string, cost double")
