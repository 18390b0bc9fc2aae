"""Operator 10, sharding by extendible hashing.

A bucket is a prefix of the bits of a document's hash. Starting from one bucket, only buckets over the byte limit
split on their next bit, until every shard fits. The directory is found from byte sums of prefixes, ``STRIDE`` bits
at a time: sums of a level's cells give those of all shorter prefixes, and only documents of cells that are still
too large are summed again, deeper. So the corpus is aggregated before each shuffle and no document is moved.

Defined results: null text has 0 bytes; a null doc_id is hashed by its text; rows with one doc_id stay in one shard; a
bucket whose rows all have one hash cannot split and is marked oversized; an empty table gives an empty table; extra
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SHARD_BYTES = 32 << 20
#: The limit of the registered query: small enough that tables of a few MB are split as well.
QUERY_BYTES = 1 << 20
BITS, STRIDE = 60, 12


def _hash() -> Column:
    """The first 60 bits of the key's MD5 hash."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text")), F.lit("text "))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the hash (``h``) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), _hash().alias("h"))


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(prefix, depth, shard_bytes, shard_docs, oversized) of every shard. ``rows`` is read once a level."""
    found = None
    start, above = 0, None
    while start < BITS:
        end = min(start + STRIDE, BITS)
        part = rows
        if above is not None:
            part = rows.withColumn("_up", F.shiftright("h", BITS - start)).join(above, "_up", "left_semi")
        cells = part.groupBy(F.shiftright("h", BITS - end).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        cells = written(cells, "cells")
        each = cells.select("*", F.explode(F.sequence(F.lit(start + (start > 0)), F.lit(end))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {end} - depth)"))
        sums = each.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        sums = sums.withColumn("stop", (F.col("b") <= limit) | (F.col("lo") == F.col("hi")))
        # a shard is the shortest prefix that fits: each cell takes its first
        first = each.join(sums.filter("stop").select("depth", "prefix"), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        leaves = first.select(F.expr(f"shiftright(cell, {end} - depth)").alias("prefix"), "depth").distinct().join(sums, ["depth", "prefix"])
        leaves = written(leaves.select("prefix", F.col("depth").cast("int").alias("depth"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"), (F.col("b") > limit).alias("oversized")), "leaves")
        found = leaves if found is None else found.union(leaves)
        above = written(cells.join(first, "cell", "left_anti").select(F.col("cell").alias("_up")), "above")
        if not above.limit(1).count():
            return found
        start = end
    return found


def _placed(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows``, which have ``h``, with ``shard`` (its hash prefix as bits), depth, shard_bytes, shard_docs, oversized."""
    depths = [r["depth"] for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # at most 61
    others = [c for c in rows.columns if c != "h"]
    # the directory is joined on each depth in use; a row has exactly one match
    at = [F.struct(F.lit(d).alias("depth"), F.expr(f"shiftright(h, {BITS - d})").alias("prefix")) for d in depths] or [F.struct(F.lit(0).alias("depth"), F.col("h").alias("prefix"))]
    placed = rows.withColumn("_at", F.explode(F.array(*at))).select(*others, F.col("_at.depth").alias("depth"), F.col("_at.prefix").alias("prefix")).join(leaves, ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return placed.select(*others, name.alias("shard"), "depth", "shard_bytes", "shard_docs", "oversized")


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (its hash prefix as bits), depth, shard_bytes, shard_docs, oversized of every document."""
    rows = written(hashed(docs), "hashed")
    return _placed(rows, directory(rows, limit))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write ``docs`` under ``path`` with one folder ``shard=...`` for each shard ("root" if there is but one).

    Each row carries its hash to its shard, so repeated and missing doc_ids lose and gain no rows.
    """
    leaves = directory(written(hashed(docs), "hashed"), limit)
    rows = docs.select(_hash().alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "shard"]).alias("_row"))
    placed = _placed(rows, leaves).select(F.when(F.col("shard") == "", "root").otherwise(F.concat(F.lit("b"), "shard")).alias("shard"), "_row")
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "shard"]
    placed.repartition("shard").select("shard", *own).write.partitionBy("shard").parquet(path)


def op10(docs: DataFrame, limit: int = QUERY_BYTES) -> DataFrame:
    return shards(docs, limit)
