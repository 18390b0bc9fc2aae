"""Operator 4, approximate nearest neighbours by a hash-prefix forest (LSH Forest: Bawa, Condie and Ganesan 2005).

Each tree gives every distinct vector a long hash string: one bit a random direction, set if the vector lies above
the sample's median there. A tree is the sorted array of its strings, dealt to tasks by the first bits in buckets
that fit in memory. A query descends to its longest matching prefixes by binary search; a first pass counts how many
vectors share each prefix length in each tree, the depth at which all trees together hold enough candidates is found
by ascending them synchronously, and a second pass takes the candidates at that depth and their exact distances.

Equal vectors are one entry with its smallest ids (as many as an answer can use), so copies cost nothing. Queries
travel to the buckets their strings name. Ascending goes past the bits that name a bucket: a query whose depth is less
than those travels to every bucket below its prefix, so it reaches every vector in the end.

How many candidates are enough depends on the vectors, so it is measured: for a sample of the queries the true
neighbours are found by comparing them with the whole table, and the number at which ascending stops is raised from
``CANDIDATES`` until the share of them that the trees find is ``RECALL``.

Defined results: null, zero and non-finite vectors, and those with null components or another length than most, take
no part; a query finds all candidates if there are fewer than k; ties go to the smaller vec_id; rows that repeat a
vec_id and its vector are one; null vec_ids take no part; an empty table gives an empty table; extra columns play no
part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

K, QUERY_STEP = 10, 100
TREES, BITS = 24, 48
#: Candidates at which ascending stops at the earliest, over all trees, copies between trees included.
CANDIDATES = 40_000
#: Share of true neighbours that the sampled queries must find, how many are sampled, and the step of the search.
RECALL, PROBED, RAISE = 0.95, 128, 1.1
#: Levels of the trees whose sizes are broadcast.
ROOT = 10
#: Vectors in a bucket of a tree, as a power of two, and the rows of the sample that sets the medians.
LEAF_BITS, SAMPLE = 9, 20_000


def usable(table: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()  # a row for each length
    return rows.filter(F.size("v") == (most["n"] if most else 0))


def _hyperplanes(dims: int, trees: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, trees * bits))


def _codes(x: np.ndarray, planes: np.ndarray, medians: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Hash strings as integers, (rows, trees); the first bit is the most significant."""
    up = (x @ planes > medians).reshape(len(x), trees, bits)
    return (up * (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).sum(axis=2)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _entries(batches: Iterator[pa.RecordBatch], planes: np.ndarray, medians: np.ndarray, trees: int, bits: int, head: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            b = whole.slice(at, 2048)
            codes = _codes(_matrix(b.column("v")), planes, medians, trees, bits)
            for t in range(trees):
                c = codes[:, t]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), t, dtype=np.int32)), pa.array(c >> (bits - head)), pa.array(c), *(b.column(n) for n in ("ids", "query", "v"))], names=["tree", "bucket", "code", "ids", "query", "v"])


def _levels(sorted_codes: np.ndarray, q: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end place in the sorted array of the codes that share each prefix length (least..bits) with ``q``."""
    lo, hi = [], []
    for n in range(least, bits + 1):
        base = (q >> (bits - n)) << (bits - n)
        lo.append(np.searchsorted(sorted_codes, base, side="left"))
        hi.append(np.searchsorted(sorted_codes, base + (1 << (bits - n)) - 1, side="right"))
    return np.stack(lo, axis=1), np.stack(hi, axis=1)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (tree, bucket), which come one after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column("tree").to_numpy().astype(np.int64) << 40 | batch.column("bucket").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if held and (held[-1].column("tree")[0], held[-1].column("bucket")[0]) != (part.column("tree")[0], part.column("bucket")[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _counts(batches: Iterator[pa.RecordBatch], bits: int, head: int) -> Iterator[pa.RecordBatch]:
    """For each query of each bucket, how many entries share each prefix length."""
    for rows in _whole_buckets(batches):
        codes = rows.column("code").to_numpy()
        query = rows.column("query").to_numpy()
        which = np.flatnonzero(query >= 0)
        if not len(which):
            continue
        lo, hi = _levels(np.sort(codes), codes[which], bits, head)
        yield pa.RecordBatch.from_arrays([pa.array(query[which]), pa.array(list(hi - lo), pa.list_(pa.int64()))], names=["query", "n"])


def _nearest(x: np.ndarray, norms: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the ``k`` rows of ``x`` nearest to ``q``, and of rows as near as the last.

    Products choose the rows, with a margin far above their rounding errors; distances are then taken by differences.
    """
    near = np.arange(len(x))
    if len(x) > k:
        own = float(q @ q)
        rough = norms - 2 * (x @ q)
        if np.isfinite(own) and np.isfinite(rough).all():
            near = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 1e-9 * (own + float(norms.max())))
    d = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
    if len(d) > k:
        keep = d <= np.partition(d, k - 1)[k - 1]
        near, d = near[keep], d[keep]
    return near, d


def _found(batches: Iterator[pa.RecordBatch], bits: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest candidates of each query that visits a bucket, at the depth that the query was given."""
    for rows in _whole_buckets(batches):
        query = rows.column("query").to_numpy()
        which, own = np.flatnonzero(query >= 0), np.flatnonzero(query < 0)
        if not len(which) or not len(own):
            continue
        depth = rows.column("depth").to_numpy().astype(np.int64)[which]
        codes = rows.column("code").to_numpy()
        base = codes[which] >> (bits - depth) << (bits - depth)
        order = own[np.argsort(codes[own], kind="stable")]
        lo = np.searchsorted(codes[order], base, side="left")
        hi = np.searchsorted(codes[order], base + (np.int64(1) << (bits - depth)) - 1, side="right")
        whole = _matrix(rows.column("v").combine_chunks())
        asked, x = whole[which], whole[order]
        del whole
        norms = (x**2).sum(axis=1)
        ids = rows.column("ids").combine_chunks()
        flat, bounds = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
        out_q, out_v, out_s = [], [], []
        for i, q in enumerate(query[which].tolist()):
            a, b = int(lo[i]), int(hi[i])
            near, d = _nearest(x[a:b], norms[a:b], asked[i], k + 1)
            for e, s in zip(order[a + near].tolist(), d.tolist(), strict=True):
                for v in flat[bounds[e] : bounds[e + 1]].tolist():
                    out_q.append(q)
                    out_v.append(v)
                    out_s.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], names=["query", "vec_id", "score"])


def _true(batches: Iterator[pa.RecordBatch], queries: np.ndarray, planes: np.ndarray, medians: np.ndarray, trees: int, bits: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest other vectors of each query in these rows: (place, score, bits shared with it in the best tree)."""
    asked = _codes(queries, planes, medians, trees, bits)
    best = [(np.zeros(0), np.zeros((0, queries.shape[1])))] * len(queries)
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            x = _matrix(whole.slice(at, 2048).column("v"))
            norms = (x**2).sum(axis=1)
            for i, q in enumerate(queries):
                near, d = _nearest(x, norms, q, k + 1)
                near, d = near[d > 0], d[d > 0]
                d, v = np.append(best[i][0], d), np.concatenate([best[i][1], x[near]])
                first = np.argsort(d, kind="stable")[:k]
                best[i] = d[first], v[first]
    for i, (d, v) in enumerate(best):
        if len(d):
            differ = _codes(v, planes, medians, trees, bits) ^ asked[i]
            shared = (bits - np.frexp(differ.astype(float))[1]).max(axis=1)  # exact: strings have fewer than 53 bits
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, dtype=np.int32)), pa.array(d), pa.array(shared.astype(np.int32))], names=["place", "score", "shared"])


def enough(shared: dict[int, list[int]], counts: dict[int, list[int]], candidates: int, recall: float) -> int:
    """The number of candidates, ``candidates`` or more, at which the sampled queries find ``recall`` of their neighbours.

    ``shared``: bits that each true neighbour shares with its query in the best tree; ``counts``: vectors that share
    each prefix length with the query, summed over the trees.
    """
    pairs = sum(map(len, shared.values()))
    while pairs:
        depth = {q: max((i for i, n in enumerate(counts[q]) if n >= candidates), default=0) for q in shared}
        if not any(depth.values()) or sum(x >= depth[q] for q, s in shared.items() for x in s) >= recall * pairs:
            break
        candidates = int(candidates * RAISE) + 1
    return candidates


def search(table: DataFrame, k: int = K, query_step: int = QUERY_STEP, trees: int = TREES, bits: int = BITS, candidates: int = CANDIDATES, leaf_bits: int = LEAF_BITS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of each row whose vec_id is divisible by ``query_step``."""
    rows = usable(table)
    # copies are one entry; of their ids the k + 1 smallest can stand in an answer, and each query id asks once
    ordered = rows.select("v", "vec_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")))
    kept = ordered.filter(F.col("place") <= k + 1)
    entries = kept.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    entries = written(entries.withColumn("query", F.lit(-1).cast("long")), "entries")
    asking = written(rows.filter(F.col("vec_id") % query_step == 0).select("v", "vec_id").distinct(), "queries")
    # equal query vectors ask as one: the smallest id stands for all
    groups = asking.groupBy("v").agg(F.min("vec_id").alias("query"))
    n = entries.count()
    if not n:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    head = max(0, int(np.ceil(np.log2(n))) - leaf_bits)
    sample = entries.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toPandas()["v"]
    x = np.array([np.asarray(r, dtype=float) for r in sample])
    planes = _hyperplanes(x.shape[1], trees, bits)
    medians = np.concatenate([np.median(x @ some, axis=0) for some in np.split(planes, trees, axis=1)])  # a tree at a time: small on the driver
    marked = entries.join(groups, "v", "left").select("ids", F.coalesce(groups["query"], F.lit(-1).cast("long")).alias("query"), "v")
    each = marked.mapInArrow(partial(_entries, planes=planes, medians=medians, trees=trees, bits=bits, head=head), "tree int, bucket long, code long, ids array<long>, query long, v array<double>")
    each = written(each.repartition("tree", "bucket"), "trees")
    dealt = each.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket")
    counts = dealt.select("tree", "bucket", "code", "query").mapInArrow(partial(_counts, bits=bits, head=head), "query long, n array<long>")
    total = counts.groupBy("query").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{head + i}") for i in range(bits - head + 1)])
    visits = each.filter("query >= 0")
    if head:  # above a bucket the counts are sums of the sizes of buckets
        sizes = each.groupBy("tree", "bucket").count()
        above = sizes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(head - 1)))).groupBy("tree", "level", F.expr(f"shiftright(bucket, {head} - level)").alias("prefix")).agg(F.sum("count").alias("n"))
        asks = visits.select("query", "tree", "bucket", F.explode(F.sequence(F.lit(0), F.lit(head - 1))).alias("level")).withColumn("prefix", F.expr(f"shiftright(bucket, {head} - level)"))
        # the few prefixes near the root, where all queries meet, are sent to all tasks: at most trees * 2 ** ROOT rows
        asks = asks.select("query", "tree", "level", "prefix")
        near = asks.join(F.broadcast(above.filter(F.col("level") <= ROOT)), ["tree", "level", "prefix"])
        if head - 1 > ROOT:
            near = near.unionByName(asks.filter(F.col("level") > ROOT).join(above.filter(F.col("level") > ROOT), ["tree", "level", "prefix"]))
        high = near.groupBy("query").agg(*[F.sum(F.when(F.col("level") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(head)])
        total = total.join(high, "query")
    total = written(total.select("query", F.array(*[F.col(f"n{i}") for i in range(bits + 1)]).alias("n")), "counts")
    # true neighbours of some queries, to learn how many candidates are enough
    sample = groups.orderBy(F.xxhash64("query"), "query").limit(PROBED).collect()
    if sample:
        queries = np.array([r["v"] for r in sample], dtype=float)
        true = entries.select("v").mapInArrow(partial(_true, queries=queries, planes=planes, medians=medians, trees=trees, bits=bits, k=k), "place int, score double, shared int")
        first = Window.partitionBy("place").orderBy("score", F.desc("shared"))
        shared: dict[int, list[int]] = {}
        for r in true.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).collect():  # at most PROBED * k rows
            shared.setdefault(sample[r["place"]]["query"], []).append(r["shared"])
        known = {r["query"]: r["n"] for r in total.filter(F.col("query").isin([r["query"] for r in sample])).collect()}
        candidates = enough(shared, known, candidates, recall)
    depth = F.greatest(F.lit(0), F.array_max(F.transform("n", lambda n, i: F.when(n >= candidates, i).otherwise(0))))
    depths = written(total.select("query", depth.cast("int").alias("depth")), "depths")
    # a query whose depth is above the buckets visits each bucket below its prefix
    size = F.expr(f"shiftleft(1L, greatest({head} - depth, 0))")
    start = F.col("bucket") - F.pmod(F.col("bucket"), size)
    probes = visits.join(depths, "query").select("tree", F.explode(F.sequence(start, start + size - 1)).alias("bucket"), "code", F.lit(None).cast("array<long>").alias("ids"), "query", "depth", "v")
    deep = each.select("tree", "bucket", "code", "ids", F.lit(-1).cast("long").alias("query"), F.lit(0).alias("depth"), "v").unionByName(probes)
    deep = deep.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket")
    found = deep.mapInArrow(partial(_found, bits=bits, k=k), "query long, vec_id long, score double").distinct()
    same = asking.join(groups, "v").select("query", F.col("vec_id").alias("query_id"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    few = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1)
    return few.join(same, "query").filter("query_id <> vec_id").withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(table: DataFrame) -> DataFrame:
    return search(table)
