"""Operator 7, quality rules as weak supervision [native: DataFrame functions only].

Each rule votes for a document (1), against it (-1) or abstains (0). No rule is trusted outright: a document is good
or has one kind of junk (``KINDS``), and expectation maximisation on the counts of vote patterns estimates how common
each of these classes is and how each rule votes in it. A document is kept if its posterior probability of being good
reaches ``THRESHOLD``: a vote against of a rule that also strikes good documents may be outvoted, and abstentions
that fit junk better may sum up. The counts of patterns (at most 3 to the number of rules rows, whatever the corpus)
are all that reaches the driver; the posterior is a column.

Votes alone can't tell which class is the good one, so the classes are anchored: a good document gets few votes
against, one with a kind of junk is mostly struck by the rules written for it. These anchors (Dirichlet priors) weigh
as much as a share of the corpus, the same at every size.

Defined results: null and blank texts have no words and are rejected by the base rule; equal rows get equal
results; an empty table gives an empty table; extra columns are kept by ``judged``, and names that clash with the
added columns (in upper or lower case) are replaced by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

THRESHOLD = 0.5
ROUNDS = 200
_SPACE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def _repeat_words() -> Column:
    """Words inside 3-word windows that the text holds twice or more, from the windows sorted by (hash, place)."""
    s = F.col("_sorted")
    return F.when(F.size(s) == 0, 0).otherwise(
        3 + F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), F.lit(0), lambda a, i: a + F.when(i < F.size(s), F.least(F.lit(3), F.get(s, i) - F.get(s, i - 1))).otherwise(0))
    )


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other counts the rules use."""
    names = [c for c in docs.columns if c.lower() not in ADDED]
    text = F.coalesce(F.col("text"), F.lit(""))
    # the input stays in one struct, so that its names can't clash with those used here
    a = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text.alias("_text"), F.split(F.btrim(text, F.lit(_BLANKS)), _SPACE).alias("_words"))
    a = a.withColumn("_n", F.when((F.size("_words") == 1) & (F.get("_words", F.lit(0)) == ""), 0).otherwise(F.size("_words")))
    triples = F.when(F.col("_n") >= 3, F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    a = a.withColumn("_triples", triples)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    a = a.withColumn("_lines", lines).withColumn("_joined", F.array_join("_words", ""))
    a = a.withColumn("_again", F.size(F.array_distinct("_triples")) < F.size("_triples"))
    a = a.withColumn("_pairs", F.when(F.col("_again"), F.sort_array(F.transform("_triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    twice = F.filter("_pairs", lambda x, i: (x["h"] == F.get("_pairs", i - 1)["h"]) | (x["h"] == F.get("_pairs", i + 1)["h"]))
    a = a.withColumn("_sorted", F.sort_array(F.transform(twice, lambda x: x["i"])))
    return a.select(
        *[F.col("_row").getField(c).alias(c) for c in names],
        F.col("_n").cast("long").alias("n_words"),
        F.char_length("_joined").cast("long").alias("word_chars"),
        F.regexp_count("_joined", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_joined", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("_joined", F.lit("!")).cast("long").alias("n_shouts"),
    )


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts", "base_failed", "posterior", "kept"]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list[Column]:
    """One vote a rule, abstaining between its two bounds and where it has nothing to measure."""
    chars, words = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    repeats = F.col("n_repeat_words") / words
    share = [
        (F.col("n_symbols") / chars, 0.005, 0.03),
        (repeats, 0.30, 0.50),
        (repeats, 0.05, 0.15),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.05, 0.30),
        (F.col("n_capitals") / chars, 0.10, 0.40),
        (F.col("n_shouts") / words, 0.02, 0.20),
    ]
    out = [F.when(F.col("n_words") == 0, 0).otherwise(_vote(x, x <= lo, x >= hi)) for x, lo, hi in share]
    mean = F.col("word_chars") / words
    out.append(F.when(F.col("n_words") == 0, 0).otherwise(_vote(mean, mean.between(3, 9), (mean < 2.5) | (mean > 12))))
    out.append(F.when(F.col("n_words") < 20, -1).when(F.col("n_words") >= 50, 1).otherwise(0))
    return out


#: The classes, and the places of the rules that are written for each kind of junk. Duplicate lines are evidence for
#: whatever class the corpus shows them in.
KINDS = {"good": (), "symbols": (0,), "repetition": (1, 2), "shouting": (4, 5), "fragments": (6, 7)}
#: Anchors: share of good documents, chances of the votes -1, 0, 1 of a rule on documents it isn't written for, and
#: on those it is; their weight where a rule is anchored, and elsewhere, in shares of the corpus.
_GOOD, _OTHER, _OWN = 0.85, (0.005, 0.045, 0.95), (0.97, 0.0295, 0.0005)
_ANCHORED, _LOOSE = 5.0, 0.05
Model = tuple[list[float], list[list[list[float]]]]


def _logs(model: Model, vote: tuple[int, ...]) -> list[float]:
    """Log of share times chance of a pattern, by class."""
    shares, chances = model
    return [math.log(w) + sum(math.log(rule[v + 1]) for rule, v in zip(rules, vote, strict=True)) for w, rules in zip(shares, chances, strict=True)]


def memberships(model: Model, vote: tuple[int, ...]) -> list[float]:
    """Posterior probability of each class, for a pattern of votes."""
    x = _logs(model, vote)
    top = max(x)
    e = [math.exp(y - top) for y in x]
    return [y / sum(e) for y in e]


def fit(patterns: list[tuple[tuple[int, ...], int]], kinds: dict[str, tuple[int, ...]] = KINDS, rounds: int = ROUNDS) -> Model:
    """Expectation maximisation: the share of each class, and the chances of -1, 0, 1 of each rule in it."""
    rules = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    own = list(kinds.values())
    start = [_GOOD, *[(1 - _GOOD) / (len(own) - 1)] * (len(own) - 1)]
    prior = [[_OWN if j in mine else _OTHER for j in range(rules)] for mine in own]
    weight = [[_ANCHORED if c == 0 or j in mine else _LOOSE for j in range(rules)] for c, mine in enumerate(own)]
    model: Model = (start, [[list(p) for p in row] for row in prior])
    for _ in range(rounds if patterns else 0):
        mass = [_LOOSE * total * w for w in start]
        n_votes = [[[weight[c][j] * total * w * p for p in prior[c][j]] for j in range(rules)] for c, w in enumerate(start)]
        for vote, n in patterns:
            for c, share in enumerate(memberships(model, vote)):
                mass[c] += n * share
                for j, v in enumerate(vote):
                    n_votes[c][j][v + 1] += n * share
        before, shares = model[0], [x / sum(mass) for x in mass]
        model = (shares, [[[x / sum(rule) for x in rule] for rule in row] for row in n_votes])
        if max(abs(x - y) for x, y in zip(shares, before, strict=True)) < 1e-9:
            break
    return model


def judged(feats: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``features`` with base_failed, posterior and kept. ``feats`` is read twice: give a written table."""
    cast = [v.alias(f"v{j}") for j, v in enumerate(votes())]
    rows = feats.select(*cast).groupBy(*[f"v{j}" for j in range(len(cast))]).count().collect()  # at most 3 ** 8 rows
    shares, chances = fit(sorted((tuple(r[:-1]), r["count"]) for r in rows), rounds=rounds)
    # log odds of each kind of junk against good, summed over the votes
    odds = []
    for share, by in zip(shares[1:], chances[1:], strict=True):
        x = F.lit(math.log(share / shares[0]))
        for j, (bad, good) in enumerate(zip(by, chances[0], strict=True)):
            x = x + F.get(F.array(*[F.lit(math.log(b / g)) for b, g in zip(bad, good, strict=True)]), F.get("_votes", F.lit(j)) + 1)
        odds.append(x)
    names = [c for c in feats.columns if c.lower() not in ("base_failed", "posterior", "kept")]
    out = feats.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), base_failed().alias("_base"), F.array(*votes()).alias("_votes"))
    out = out.select("_row", "_base", (1 / (1 + sum((F.exp(x) for x in odds), F.lit(0.0)))).alias("_posterior"))
    row = [F.col("_row").getField(c).alias(c) for c in names]
    return out.select(*row, F.col("_base").alias("base_failed"), F.col("_posterior").alias("posterior"), (~F.col("_base") & (F.col("_posterior") >= THRESHOLD)).alias("kept"))


def op7(docs: DataFrame) -> DataFrame:
    out = judged(written(features(docs.select(F.col("doc_id").cast("long"), "text")).drop("text"), "features"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
