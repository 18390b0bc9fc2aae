"""Operator 9, mixing to target weights with soft memberships [native: DataFrame functions only].

A naive Bayes classifier, fitted on labelled rows, gives each document a posterior for every domain (here: its
language). Projected gradient descent then fits a nonnegative rate for each document, the number of times it should
be seen, so that the expected tokens of every domain (rate times tokens times posterior, summed) match the target
weights: least squares on the domains' relative errors, with steps scaled by a document's tokens and projected on
rates of 0 or more. Each step is one distributed aggregation to a row of domain totals; rates are recomputed from the
steps' gradients, so nothing that grows with the corpus reaches the driver.

Defined results: null and blank texts have no tokens and the prior as their posterior; null labels take no part in
fitting; every domain of the labelled rows is a class; without labelled rows there are no domains, every posterior is
null and every rate 1; a target for a domain without a class is an error; targets that the rates miss by more than
``MISSED`` of all tokens are warned of; repeated rows each have their rate; an empty table gives an empty table; extra
columns of any name are kept by ``resampled`` and play no part.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_KEYS, written

#: Labelled rows that the classifier is fitted on, those taken of each domain in any case, and words of each domain that
#: are features of the classifier (the commonest; the model is a table of at most domains * WORDS rows).
LABELLED, EACH, WORDS = 5_000, 100, 400
#: Default target: shares of the domains' tokens to this power.
TEMPERATURE = 0.7
STEPS, TOLERANCE, MISSED = 60, 1e-7, 1e-3


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _sum(parts: list[Column]) -> Column:
    """The sum of the columns, nested no deeper than sixteen a level."""
    while len(parts) > 1:
        parts = [sum(parts[i : i + 16], F.lit(0.0)) for i in range(0, len(parts), 16)]
    return parts[0]


def fit(docs: DataFrame, labelled: DataFrame, domain: str) -> tuple[list[str], dict[str, float], DataFrame | None]:
    """Domains, their log priors, and the model's table (word, l0, l1, ...): log chances of each word by domain.

    ``labelled`` has the doc_ids whose ``domain`` is trusted. The first ``LABELLED`` of them are used, in order of a
    hash, and the first ``EACH`` of every domain, so that each domain among them is a class.
    """
    ids = labelled.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    hint = (lambda x: F.broadcast(x)) if ids.count() <= BROADCAST_KEYS else (lambda x: x.hint("shuffle_merge"))
    known = docs.filter(F.col(domain).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain).cast("string").alias("y"), "text")
    order = F.xxhash64("doc_id")
    chosen = ids.orderBy(order, "doc_id").limit(LABELLED)
    trusted = known.select("doc_id", "y").join(hint(ids), "doc_id", "left_semi")
    few = trusted
    for parts in (256, 16, 1):  # parts first: a domain's rows are no single task's work, whose last takes 16 * EACH of them
        dealt = Window.partitionBy("y", F.pmod(order, F.lit(parts))).orderBy(order, "doc_id")
        few = few.withColumn("r", F.row_number().over(dealt)).filter(F.col("r") <= EACH)
    chosen = written(chosen.union(few.select("doc_id")).distinct(), "chosen")
    rows = written(known.join(F.broadcast(chosen), "doc_id", "left_semi").select("y", "text"), "labelled")
    counts = rows.groupBy("y").count().collect()  # a row for each domain
    names = sorted(r["y"] for r in counts)
    if not names:
        return [], {}, None
    total = sum(r["count"] for r in counts)
    prior = {r["y"]: math.log(r["count"] / total) for r in counts}
    k = range(len(names))
    place = (F.array_position(F.array(*[F.lit(y) for y in names]), F.col("y")) - 1).cast("int")
    n = written(rows.select(place.alias("i"), F.explode(_words(F.col("text"))).alias("word")).groupBy("i", "word").count(), "words")
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("count"), "word"))).filter(F.col("r") <= WORDS)
    n = n.join(F.broadcast(top.select("word").distinct()), "word", "left_semi")  # at most domains * WORDS words
    n = n.groupBy("word").pivot("i", list(k)).sum("count").na.fill(0, [str(i) for i in k])
    sums = n.agg(*[F.sum(F.col(f"`{i}`") + 0.5).alias(str(i)) for i in k]).first()
    # without any word every sum is null and the table has no rows
    table = n.select("word", *[F.log((F.col(f"`{i}`") + 0.5) / F.lit(float(sums[i] or 1.0))).alias(f"l{i}") for i in k])
    return names, prior, written(table, "model")


def posteriors(docs: DataFrame, names: list[str], prior: dict[str, float], model: DataFrame | None) -> DataFrame:
    """(_row, n_tokens, p0, p1, ...) of each row of ``docs``, which has ``_row`` and ``text``.

    ``_each`` keeps equal rows apart while their words are summed, within one job.
    """
    tokens = F.size(F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+"))
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    rows = docs.select(F.monotonically_increasing_id().alias("_each"), "_row", F.when(blank, 0).otherwise(tokens).cast("long").alias("n_tokens"), "text")
    if model is None:
        return rows.select("_row", "n_tokens")
    # the outer explode keeps rows without words; the model is small by its parameters, so it is sent to all tasks
    each = rows.select("_each", "_row", "n_tokens", F.explode_outer(_words(F.coalesce("text", F.lit("")))).alias("word")).join(F.broadcast(model), "word", "left")
    sums = each.groupBy("_each", "_row", "n_tokens").agg(*[F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(names))])
    score = [F.col(f"s{i}") + F.lit(prior[y]) for i, y in enumerate(names)]
    top = F.greatest(*score) if len(score) > 1 else score[0]
    sums = sums.select("_row", "n_tokens", *[F.exp(x - top).alias(f"e{i}") for i, x in enumerate(score)])
    whole = _sum([F.col(f"e{i}") for i in range(len(names))])
    return sums.select("_row", "n_tokens", *[(F.col(f"e{i}") / whole).alias(f"p{i}") for i in range(len(names))])


def _rate(steps: list[list[float]]) -> Column:
    """The rate after the given steps, each projected on nonnegative values."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    all_steps = F.array(*[F.array(*[F.lit(x) for x in g]) for g in steps])
    p = [F.col(f"p{i}") for i in range(len(steps[0]))]
    return F.aggregate(all_steps, rate, lambda r, g: F.greatest(F.lit(0.0), r - _sum([x * F.get(g, F.lit(i)) for i, x in enumerate(p)])))


def rates(soft: DataFrame, names: list[str], targets: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> tuple[list[list[float]], list[float]]:
    """The gradient steps that fit the rates, and the relative error left in each domain."""
    k = len(names)

    def totals(steps: list[list[float]]) -> list[float]:
        r = _rate(steps)
        row = soft.select((r * F.col("n_tokens")).alias("m"), *[f"p{i}" for i in range(k)]).agg(*[F.sum(F.col("m") * F.col(f"p{i}")) for i in range(k)]).first()
        return [x or 0.0 for x in row]

    start = totals([])
    whole = sum(start)
    if not whole:
        return [], [0.0] * k
    share = [s / whole for s in start]
    want = [targets.get(y, 0.0) for y in names] if targets else [s**temperature if s > 0 else 0.0 for s in share]
    want = [x / sum(want) for x in want]
    scale = [max(s, 1e-12 * whole) for s in start]
    steps: list[list[float]] = []
    now = start
    for _ in range(STEPS):
        g = [(y - t * whole) / s for y, t, s in zip(now, want, scale, strict=True)]
        if max(abs(x) for x in g) < TOLERANCE:
            break
        steps.append(g)
        now = totals(steps)
    return steps, [(y - t * whole) / whole for y, t in zip(now, want, strict=True)]


def mixed(docs: DataFrame, labelled: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None) -> tuple[DataFrame, list[list[float]], dict[str, float]]:
    """(per row: _row, n_tokens, domain, posteriors, rate), the steps, and by how much of all tokens each target is missed.

    ``_row`` names a row of ``docs`` by its content, so equal rows share one and recomputed tasks agree on it.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(f"`{domain}`").alias("_domain"))
    names, prior, model = fit(slim, labelled, "_domain")
    if missing := sorted(y for y, x in (targets or {}).items() if x > 0 and y not in names):
        raise ValueError(f"no labelled rows for the domains of these targets: {missing}")
    soft = written(posteriors(slim.select(_name().alias("_row"), "text"), names, prior, model), "soft")
    if not names:
        return soft.select("_row", "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("array<double>").alias("posteriors"), F.lit(1.0).alias("rate")), [], {}
    steps, left = rates(soft, names, targets)
    missed = dict(zip(names, left, strict=True))
    if max(map(abs, left)) > MISSED:
        warnings.warn(f"rates miss their targets, in shares of all tokens: {missed}", stacklevel=2)
    p = [F.col(f"p{i}") for i in range(len(names))]
    best = F.greatest(*p) if len(p) > 1 else p[0]
    label = F.coalesce(*[F.when(x == best, F.lit(y)) for x, y in zip(p, names, strict=True)])
    return soft.select("_row", "n_tokens", label.alias("domain"), F.array(*p).alias("posteriors"), _rate(steps).alias("rate")), steps, missed


def _name() -> Column:
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, the likeliest domain, its posterior, and the rate of every document."""
    out, _, _ = mixed(docs, labels)
    return out.select(F.col("_row.id").alias("doc_id"), "n_tokens", "domain", F.array_max("posteriors").alias("posterior"), "rate")


def resampled(docs: DataFrame, labelled: DataFrame, domain: str = "lang", targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row as often as its rate says, in its own columns.

    Rates are scaled so that the domain in least demand is seen once: rows are repeated, none is lost, and the result
    grows by the inverse of the least rate. (Domains with a target of 0 are seen once as well.) The part of a rate
    after the point becomes a further copy for that share of the rows, chosen by a hash of the row.
    """
    out, steps, _ = mixed(docs, labelled, domain, targets)
    least = 1.0
    if steps:
        pure = [1.0] * len(steps[0])  # rates of rows that surely are of one domain
        for g in steps:
            pure = [max(0.0, r - x) for r, x in zip(pure, g, strict=True)]
        least = min((r for r in pure if r > 0), default=1.0)
    r = F.greatest(F.lit(1.0), F.round(F.col("rate") / F.lit(least), 9))
    chance = F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = (F.floor(r) + (chance < r - F.floor(r)).cast("int")).cast("int")
    # equal rows were counted one by one; each asks for the same copies
    times = out.select("_row", copies.alias("_copies")).distinct()
    whole = docs.select(_name().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))  # no name can clash
    each = whole.join(times, "_row").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return each.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
