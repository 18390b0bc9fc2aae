"""Samplers that bound the size of a front; seeded, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offset(seed: int, *keys: str) -> Column:
    """A number in [0, 1) for each combination of keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def universal(front: DataFrame, keys: list[str], f: str, order: list[Column], k: int, alpha: float, position: int | Column, u0: float | Column) -> DataFrame:
    """Stochastic universal sampling: at most ``k`` rows a key, weighted by (mean cost a position + 1) ** -alpha.

    ``k`` evenly spaced pointers, shifted by ``u0`` of a step, fall on the running sum of weights; rows that a pointer
    hits stay. Keys with at most ``k`` rows keep all, as does ``k`` = 0.
    """
    if k == 0:
        return front
    own = Window.partitionBy(*keys)
    run = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = position if isinstance(position, Column) else F.lit(float(position))
    u = u0 if isinstance(u0, Column) else F.lit(float(u0))
    df = front.withColumn("_w", F.pow(-F.col(f) / at + 1, F.lit(-alpha))).withColumn("_n", F.count("*").over(own))
    df = df.withColumn("_cum", F.sum("_w").over(run)).withColumn("_step", F.sum("_w").over(own) / k)
    upto = F.floor(F.col("_cum") / F.col("_step") - u)
    before = F.coalesce(F.lag(F.floor(F.col("_cum") / F.col("_step") - u)).over(own.orderBy(*order)), F.lit(-1))
    df = df.withColumn("_hit", upto > before)
    return df.filter((F.col("_n") <= k) | F.col("_hit")).drop("_w", "_n", "_cum", "_step", "_hit")


def ranked(front: DataFrame, keys: list[str], order: list[Column], k: int, alphas: list[float], ratios: list[float]) -> DataFrame:
    """Rows at the ranks round(j ** alpha * (n - 1)) of each (alpha, ratio), j evenly spaced; the first ``k`` of them."""
    if k == 0:
        return front
    own = Window.partitionBy(*keys)
    df = front.withColumn("_r", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(own))
    picks = []
    for alpha, ratio in zip(alphas, ratios, strict=True):
        part = max(1, round(k * ratio))
        for x in ([0.0] if part == 1 else [i / (part - 1) for i in range(part)]):
            picks.append(F.bround(F.lit(float(x**alpha)) * (F.col("_n") - 1), 0).cast("int"))
    df = df.withColumn("_hit", F.array_contains(F.array(*picks), F.col("_r")))
    df = df.filter((F.col("_n") <= k) | F.col("_hit")).withColumn("_k", F.row_number().over(own.orderBy(*order)))
    return df.filter((F.col("_n") <= k) | (F.col("_k") <= k)).drop("_r", "_n", "_hit", "_k")


#: Exponents and shares of the budget of each phase of a sequence.
PHASES = {
    "none": ((1.5, 1.0), (0.5, 0.5)),
    "upstream": ((1.8, 1.1), (0.5, 0.5)),
    "codon 1 or 2": ((1.05, 1.0), (0.5, 0.5)),
    "codon 3": ((4.5, 1.2), (0.7, 0.3)),
    "downstream": ((2.5, 1.5), (0.8, 0.2)),
}


def phase(position: Column, first: Column, last: Column) -> Column:
    """The phase of a position with respect to a coding region (null: none)."""
    third = F.pmod(position - first, F.lit(3)) == 2
    return F.when(first.isNull() | last.isNull(), "none").when(position < first, "upstream").when(position > last, "downstream").when(third, "codon 3").otherwise("codon 1 or 2")


def phase_sampler(front: DataFrame, keys: list[str], order: list[Column], k: int, phase: str) -> DataFrame:
    """The ranked sampler with the exponents and shares of a phase."""
    alphas, ratios = PHASES[phase]
    return ranked(front, keys, order, k, list(alphas), list(ratios))


def params_id(k: int, alpha: float | None = None, alphas: tuple[float, ...] | None = None, ratios: tuple[float, ...] | None = None) -> str:
    """The name of a sampler's parameters, as used in paths of results."""
    if alphas is not None:
        return f"k_{k}__alphas_{tuple(alphas)}__ratios_{tuple(ratios or ())}"
    return f"k_{k}" if alpha is None or k == 0 else f"k_{k}__alpha_{alpha}"


def sampler_name(k: Column, alpha: Column) -> Column:
    """``params_id`` of rows with their own budget and exponent."""
    name = F.concat(F.lit("k_"), k.cast("string"))
    return F.when(k > 0, F.concat(name, F.lit("__alpha_"), alpha.cast("string"))).otherwise(name)


#: Strategies by name: each takes (front, keys, f, order, k, position, parameters).
STRATEGIES = {
    "none": lambda front, keys, f, order, k, position, **p: front,
    "universal": lambda front, keys, f, order, k, position, **p: universal(front, keys, f, order, k, p.get("alpha", 1.0), position, p.get("u0", 0.5)),
    "ranked": lambda front, keys, f, order, k, position, **p: ranked(front, keys, order, k, list(p["alphas"]), list(p["ratios"])),
    "phase": lambda front, keys, f, order, k, position, **p: phase_sampler(front, keys, order, k, p["phase"]),
}


def sample(front: DataFrame, keys: list[str], f: str, order: list[Column], k: int, position: int = 1, method: str = "universal", **parameters) -> DataFrame:
    """Bound each key's rows by the strategy named ``method``; more can be added to ``STRATEGIES``."""
    if method not in STRATEGIES:
        raise ValueError(f"unknown method {method}")
    return STRATEGIES[method](front, keys, f, order, k, position, **parameters)
