"""Operator 8, n-gram Jaccard join of documents: five-word shingles, similarity of 0.8 or more.

Method: rare-first prefix filtering. Documents with equal sets are one class, decided by a 128-bit hash. A first
pass over all classes takes a somewhat longer prefix of each, in an order by bucketed counts over the whole corpus
(a table of fixed size), and keeps the classes that share as many of its shingles with others as a partner must
share. Among these candidates the shingles get exact counts and the exact rare-first order, in which the length and
positional filters act. Pairs are joined on prefix
shingles, pass a suffix filter (counts of tokens in ranges of the hash space), are made distinct, checked once by an
exact intersection, and closed to components.

Pairs within a component need no check, so a first round joins each document to a few of those that stand before it
in the groups of its shingles, in an order that differs from group to group, and to the most typical member of each
group, the one whose shingles are most shared. A second round takes every pair between different components that
passes the filters, so no link between components is lost.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer than five
words is one shingle; rows without doc_id take no part (component_id null); rows that share a doc_id are judged each by
its own text, and each has its row in the result; an empty table gives an empty table; extra columns play no part. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .hashing import U, mix, signed, texts_of, window_hash, word_hashes
from .shared import BROADCAST_KEYS, freed, frugal, only_keys, written

WORDS = 5
#: Similarity in hundredths.
SIMILARITY = 80
#: Partners that the first round checks of each document, and neighbours in a group that it looks at.
PARTNERS, LAGS = 8, 3
#: Members of a group that the first round orders together; a larger group is dealt out.
GROUP = 1000
#: Ranges of the suffix filter.
RANGES = 128
#: Buckets of the corpus-wide count table that orders shingles in the first pass: its size is fixed.
BUCKETS, SLICES = 1 << 18, 16


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row with a word."""
    data, offsets = texts_of(batch.column("text"))
    for i, j, h, rows in word_hashes(data, offsets, lower=True):
        grams = window_hash(h, WORDS)
        for r in range(j - i):
            a, b = int(rows[r]), int(rows[r + 1])
            if b - a >= WORDS:
                yield i + r, np.unique(grams[a : b - WORDS + 1])
            elif b > a:
                yield i + r, mix(window_hash(h[a:b], b - a) + U(b - a))


def first_look(n: int, percent: int) -> tuple[int, int]:
    """Tokens of a set of ``n`` that the first pass looks at, and how many of them a partner must share.

    A partner lacks at most n - ceil(percent * n / 100) tokens, so among any more than that it shares the rest.
    """
    lacking = n - -(-percent * n // 100)
    look = min(n, lacking + 1 + n // 10)
    return look, look - lacking


@frugal
def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document (k, n, c1, c2); at the end the task's count table in slices (k null)."""
    table, held = np.zeros(BUCKETS, dtype=np.int64), [np.zeros(0, dtype=U)]
    names = ["k", "n", "c1", "c2", "slice", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        n = np.zeros(batch.num_rows, dtype=np.int64)
        c = np.zeros((2, batch.num_rows), dtype=np.int64)
        for r, s in _sets(batch):
            n[r] = len(s)
            c[:, r] = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
            held.append(s >> U(46))
            if sum(map(len, held[-64:])) > BUCKETS or len(held) >= 2048:
                table += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS)
                held.clear()
        none = pa.nulls(batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n), pa.array(c[0]), pa.array(c[1]), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
    table += np.bincount(np.concatenate([*held, np.zeros(0, dtype=U)]).astype(np.int64), minlength=BUCKETS)
    each = table.reshape(SLICES, -1)
    none = pa.nulls(SLICES).cast(pa.int64())
    if table.any():
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array([x.astype(np.int32).tobytes() for x in each], types[5])], names=names)


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BUCKETS // SLICES, dtype=np.int64)
    for x in pdf["counts"]:
        total += np.frombuffer(x, dtype=np.int64 if len(x) == 8 * len(total) else np.int32)
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "counts": [total.tobytes()]})


@frugal
def _prefixes(batches: Iterator[pa.RecordBatch], counts, percent: int) -> Iterator[pa.RecordBatch]:
    table = counts.value
    for batch in batches:
        ids = batch.column("k").to_numpy()
        h, rows, need = [], [], []
        for r, s in _sets(batch):
            m, least = first_look(len(s), percent)
            rare = s[np.lexsort((s, table[(s >> U(46)).astype(np.int64)]))[:m]]
            need.append(np.full(m, least, dtype=np.int32))
            h.append(rare)
            rows.append(np.full(m, ids[r]))
        if h:
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(h))), pa.array(np.concatenate(rows)), pa.array(np.concatenate(need))], names=["h", "k", "need"])


@frugal
def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("k").to_numpy()
        found = list(_sets(batch))
        yield pa.RecordBatch.from_arrays([pa.array(ids[[r for r, _ in found]]), pa.array([len(s) for _, s in found], pa.int64()), pa.array([signed(s) for _, s in found], pa.list_(pa.int64())), pa.array([np.bincount((s & U(RANGES - 1)).astype(np.int64), minlength=RANGES) for _, s in found], pa.list_(pa.int32()))], names=["k", "n", "tokens", "ranges"])


@frugal
def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar enough."""
    for batch in batches:
        sides = []
        for name in ("ta", "tb"):
            column = batch.column(name)
            sides.append((column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()))
        keep = np.zeros(batch.num_rows, dtype=bool)
        for r in range(batch.num_rows):
            a, b = (np.sort(v[o[r] : o[r + 1]]) for v, o in sides)
            total = len(a) + len(b)
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[r] = 100 * both >= percent * (total - both)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])


def _may_link(percent: int):
    """Length filter and positional filter of two prefix entries (na, pa) and (nb, pb)."""
    return (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent) & ((1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)


def _overlap_bound() -> Column:
    """Suffix filter: tokens fall into ranges of the hash space, and two sets share at most the smaller count of each."""
    return F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = pairs.distinct().join(sets.select(F.col("k").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("k").alias("b"), F.col("tokens").alias("tb")), "b")
    return pairs.mapInArrow(partial(_linked, percent=percent), "a long, b long")


def class_table(key: DataFrame, percent: int = SIMILARITY, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """(per row: k, n, cls), (per class with a partner: cls, comp). ``key``: (k, text), equal k only for equal texts.

    ``unique``: no two rows share a k, so no shuffle is needed to take one of them.
    """
    spark = key.sparkSession
    once = (lambda df: df) if unique else (lambda df: df.dropDuplicates(["k"]))
    both = written(key.mapInArrow(_classes, "k long, n long, c1 long, c2 long, slice int, counts binary"), "classes")
    rows = both.filter("slice is null").select("k", "n", "c1", "c2")
    counts = np.zeros((SLICES, BUCKETS // SLICES), dtype=np.int64)
    for r in both.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(_summed, "slice int, counts binary").collect():  # 2 MB at any size
        counts[r["slice"]] = np.frombuffer(r["counts"], dtype=np.int64)
    shared_counts = spark.sparkContext.broadcast(counts.ravel())

    reps = rows.filter("n > 0").groupBy("c1", "c2").agg(F.min("k").alias("cls"), F.max("n").alias("n"))
    single = once(only_keys(key, written(reps.select(F.col("cls").alias("k")), "reps"), "k"))
    entry = single.mapInArrow(partial(_prefixes, counts=shared_counts, percent=percent), "h long, k long, need int")
    # shingles that several classes hold (a class has one entry of each): pre-aggregated, so a common one is no single task's work
    held = written(entry.groupBy("h").count().filter("count > 1").select("h"), "held")
    near = entry.join(held.hint("shuffle_merge"), "h", "left_semi")  # one way at every size: these keys grow with the corpus
    candidates = written(near.groupBy("k", "need").count().filter("count >= need").select("k").distinct(), "candidates")

    sets = written(once(only_keys(key, candidates, "k")).mapInArrow(_token_sets, "k long, n long, tokens array<long>, ranges array<int>"), "sets")
    freed(held, candidates)
    token = sets.select("k", "n", F.explode("tokens").alias("h"))
    own = Window.partitionBy("k")
    often = token.join(token.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "h")
    alone = F.col("n") - F.count("*").over(own)
    odd = (alone + F.sum(1 / F.col("df")).over(own)) / F.col("n")
    ranked = often.select("k", "n", "h", "df", odd.alias("odd"), (alone + F.row_number().over(own.orderBy("df", "h")) - 1).alias("p"))
    prefixes = written(ranked.filter(F.col("p") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1), "prefixes")

    # partners: a few neighbours in part of the group, in an order that differs by group, and its most typical member
    part = F.pmod(F.xxhash64("k"), F.ceil(F.col("df") / GROUP))
    group = Window.partitionBy("h", "part").orderBy(F.xxhash64("h", "k"))
    me = F.struct("k", "n", "p")
    lags = prefixes.withColumn("part", part).withColumn("me", me)
    for i in range(1, LAGS + 1):
        lags = lags.withColumn(f"o{i}", F.lag("me", i).over(group))
    hub = prefixes.groupBy("h").agg(F.min_by(me, F.struct("odd", "k")).alias("hub"))
    first = lags.join(hub, "h").select(F.col("k").alias("ka"), F.col("n").alias("na"), F.col("p").alias("pa"), F.explode(F.array_compact(F.array("hub", *(f"o{i}" for i in range(1, LAGS + 1))))).alias("o"))
    first = first.select("ka", "na", "pa", F.col("o.k").alias("kb"), F.col("o.n").alias("nb"), F.col("o.p").alias("pb")).filter("ka <> kb").filter(_may_link(percent))
    # a few partners a document are enough here, those met most often: the second round misses nothing
    best = Window.partitionBy("ka").orderBy(F.desc("count"), F.xxhash64("kb"), "kb")
    pairs = first.groupBy("ka", "kb").count().withColumn("at", F.row_number().over(best)).filter(F.col("at") <= PARTNERS).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    links = written(_verified(pairs, sets, percent), "links")
    comps = components(links)

    entry = prefixes.join(comps.withColumnRenamed("node", "k"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    sizes = entry.groupBy("h", "comp").agg(F.count("*").alias("size")).groupBy("h").agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("size", "comp")).alias("main")).filter("parts > 1")
    entry = written(entry.join(sizes.select("h", "main"), "h").join(sets.select("k", "ranges"), "k"), "entries")
    freed(prefixes)
    one = entry.filter("comp <> main").select("h", F.col("k").alias("ka"), F.col("n").alias("na"), F.col("p").alias("pa"), F.col("comp").alias("ca"), F.col("ranges").alias("ra"))
    other = entry.select("h", F.col("k").alias("kb"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("comp").alias("cb"), F.col("ranges").alias("rb"))
    enough = _overlap_bound() * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    pairs = one.join(other, "h").filter("ca <> cb").filter(_may_link(percent)).filter(enough).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    more = written(_verified(pairs, sets, percent), "links")
    freed(entry, sets)
    final = components(links.union(more)) if more.limit(1).count() else comps
    freed(links, more)
    return rows.join(reps.select("c1", "c2", "cls"), ["c1", "c2"], "left").select("k", "n", "cls"), final.select(F.col("node").alias("cls"), "comp")


def op8(docs: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    key = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("k"), "text")
    shared = written(key.groupBy("k").count().filter("count > 1").select("k", F.lit(True).alias("shared")), "shared")
    if n_shared := shared.count():  # rows that share a doc_id get keys of 62 bits from doc_id and text
        key = key.join(F.broadcast(shared) if n_shared <= BROADCAST_KEYS else shared.hint("shuffle_merge"), "k", "left")
        own = F.lit(2**62) + F.xxhash64("k", "text").bitwiseAND(2**62 - 1)
        key = written(key.select(F.when(F.col("shared"), own).otherwise(F.col("k")).alias("k"), F.col("k").alias("id"), "text"), "keys")
    rows, comps = class_table(key.select("k", "text"), percent, not n_shared)
    linked = rows.join(comps, "cls", "left").select("k", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "cls")).otherwise(F.col("k")).alias("component_id"))
    if n_shared:
        ids = key.select("k", "id").distinct()
        linked = linked.join(ids, "k")
        least = linked.groupBy("component_id").agg(F.min("id").alias("least"))
        linked = linked.join(least, "component_id").select(F.col("id").alias("k"), "n_shingles", F.col("least").alias("component_id"))
    without = docs.filter("doc_id is null").select("text").mapInArrow(_sizes, "n long")
    return linked.select(F.col("k").alias("doc_id"), "n_shingles", "component_id").union(without.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))


@frugal
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.zeros(batch.num_rows, dtype=np.int64)
        for r, s in _sets(batch):
            n[r] = len(s)
        yield pa.RecordBatch.from_arrays([pa.array(n)], names=["n"])
