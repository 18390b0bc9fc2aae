"""Operator 11, a Merkle manifest: hash trees by source under one root, with the proof of every row.

A row's leaf is the SHA-256 of its fields, each with its length; a node is the SHA-256 of its children's hex digests,
one after another, with ``fanout`` children (the last node of a level takes what is left). The leaves of a source, by
doc_id, make its subroot; the subroots, by source, make the root.

Rows are numbered within their source by a range sort and the counts of its ranges, so a source of any size is many
tasks. A block is ``fanout ** LEVELS`` consecutive leaves from a multiple of that number: its digests are one contiguous
NumPy matrix, a level is that matrix reshaped by the fanout and hashed row by row, and siblings follow from index
arithmetic. Blocks' nodes are the next table, and so on until each source has one node; the way back down hands each
block the path above it as a row that sorts before its leaves, so no join and no group larger than a block is needed.
Texts are hashed where they are read and travel nowhere.

Defined results: a null field is ``-``; null sources are one source, before all others; rows without doc_id stand
before the others of their source; rows that share a doc_id stand in order of their leaves, and each has its own
proof; empty texts are fields of length 0; an empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_KEYS, frugal, scratch, written

FANOUT = 3
#: Levels of the tree inside a block: 3 ** 8 = 6,561 leaves.
LEVELS = 8

_HEX = np.array([list(f"{i:02x}".encode()) for i in range(256)], dtype=np.uint8)
_ROW = "g string, pos long, n long, id string, digest binary, other binary"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The hex digest of a row of ``documents`` with ``text`` as its text."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)), 256)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (g, id, digest, other and the columns of ``order``) with ``pos``, the place in g from 0, and ``n``, g's rows.

    The range sort splits a large g over tasks; a range's first place follows from the counts of the ranges before it.
    """
    at = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_at", F.monotonically_increasing_id())
    at = written(at.select("g", "id", "digest", "other", "_at", F.shiftright("_at", 33).alias("_part")), "ranges")
    counts = at.groupBy("g", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("g")
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("g", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n")), "counts")
    small = counts.count() <= BROADCAST_KEYS // 10
    joined = at.join(F.broadcast(counts) if small else counts.hint("shuffle_merge"), ["g", "_part"])
    return joined.select("g", (F.col("_at") + F.col("_shift")).alias("pos"), "n", "id", "digest", "other")


def _hex(raw: pa.Array) -> np.ndarray:
    """Digests of 32 bytes as a contiguous matrix of 64 hex characters a row."""
    return _HEX[np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)].reshape(-1, 64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (g, block), which come one after another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g, block = batch.column("g"), batch.column("block").to_numpy()
        new = np.append(True, (block[1:] != block[:-1]) | pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False))
        cuts = np.append(np.flatnonzero(new), batch.num_rows).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = (g[a].as_py(), int(block[a]))
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _height(n: int, fanout: int, most: int) -> int:
    """Levels above ``n`` nodes, but at most ``most``."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The level above: the matrix reshaped by the fanout, each row hashed; the last, shorter run by itself."""
    whole = len(nodes) // fanout * fanout
    digests = [hashlib.sha256(run).hexdigest() for run in nodes[:whole].reshape(-1, fanout * 64)]
    if whole < len(nodes):
        digests.append(hashlib.sha256(nodes[whole:].reshape(-1)).hexdigest())
    return np.frombuffer("".join(digests).encode(), dtype=np.uint8).reshape(-1, 64)


def _raw(nodes: np.ndarray) -> list[bytes]:
    return [bytes.fromhex(row.tobytes().decode()) for row in nodes]


def _up(batches: Iterator[pa.RecordBatch], fanout: int, levels: int) -> Iterator[pa.RecordBatch]:
    """The node of each block, as a row of the next table."""
    out: list[tuple] = []
    for block in _segments(batches):
        nodes, n = _hex(block.column("digest")), block.column("n")[0].as_py()
        for _ in range(_height(n, fanout, levels)):
            nodes = _parents(nodes, fanout)
        out.append((block.column("g")[0].as_py(), block.column("block")[0].as_py(), -(-n // fanout**levels), None, _raw(nodes)[0], None))
        if len(out) == 4096:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["g", "pos", "n", "id", "digest", "other"])


def _down(batches: Iterator[pa.RecordBatch], fanout: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Each row with its path: by level its place and its siblings, from its block's matrices, then the path above the block.

    A block's first row is the path above it, and the subroot.
    """
    for block in _segments(batches):
        above, root = block.column("path")[0].as_py(), block.column("subroot")[0]
        rows = block.slice(1)
        m = rows.num_rows
        nodes, n, index = _hex(rows.column("digest")), rows.column("n")[0].as_py(), np.arange(m)
        paths: list[list[bytes]] = [[] for _ in range(m)]
        for _ in range(_height(n, fanout, levels)):
            run, place = np.divmod(index, fanout)
            size = np.minimum(fanout, len(nodes) - run * fanout)
            raw = np.frombuffer(b"".join(_raw(nodes)), dtype=np.uint8).reshape(-1, 32)
            for i, (r, p, s) in enumerate(zip((run * fanout).tolist(), place.tolist(), size.tolist(), strict=True)):
                paths[i] += (bytes((p, s - 1)), raw[r : r + p].tobytes(), raw[r + p + 1 : r + s].tobytes())
            nodes, index = _parents(nodes, fanout), run
        own = [b"".join(x) + above for x in paths]
        for a in range(0, m, 1024):
            b = min(m, a + 1024)
            part = rows.slice(a, b - a).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("g", "pos", "id", "digest", "other")), pa.array(own[a:b], pa.binary()), pa.array([root.as_py()] * (b - a), pa.binary())], names=["g", "pos", "id", "digest", "other", "path", "subroot"])


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("block", F.expr(f"pos div {size}"))


def _tree(rows: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The tables of nodes, from ``rows`` to one node for each g; each has one ``fanout ** levels``-th of the rows before."""
    tables = [rows]
    while len(tables) == 1 or (tables[-1].agg(F.max("n")).first()[0] or 0) > 1:
        dealt = _dealt(tables[-1], fanout**levels).select("g", "block", "pos", "n", "digest")
        dealt = dealt.repartition("g", "block").sortWithinPartitions("g", "block", "pos")
        tables.append(written(dealt.mapInArrow(partial(_up, fanout=fanout, levels=levels), _ROW), "nodes"))
    return tables


def _below(rows: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``rows`` with path and subroot; ``above`` (g, pos, path, subroot) has those of their blocks."""
    none = F.lit(None)
    heads = above.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), none.cast("long").alias("n"), none.cast("string").alias("id"), none.cast("binary").alias("digest"), none.cast("binary").alias("other"), "path", "subroot")
    leaves = _dealt(rows, fanout**levels).select("g", "block", "pos", "n", "id", "digest", "other", none.cast("binary").alias("path"), none.cast("binary").alias("subroot"))
    dealt = leaves.unionByName(heads).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    return dealt.mapInArrow(partial(_down, fanout=fanout, levels=levels), "g string, pos long, id string, digest binary, other binary, path binary, subroot binary")


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, str | None]:
    """(doc_id, source, leaf, other, subroot, path) of every row of ``leaves`` (doc_id, source, leaf, other), and the root.

    Leaves come as hex, digests of the result are raw bytes. ``other`` is a second digest that is carried along. A path
    holds, level by level, a byte with the row's place in its run, a byte with the number of its siblings, and these. The
    root (hex) is None for an empty table.
    """
    with scratch(leaves.sparkSession) as keep:
        rows = leaves.select(F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("g"), F.col("doc_id").cast("long").alias("id"), F.unhex("leaf").alias("digest"), F.unhex("other").alias("other"))
        rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
        docs = _tree(keep(written(_numbered(rows, "id", "digest", "_row").withColumn("id", F.col("id").cast("string")), "numbered")), fanout, levels)
        subroots = docs[-1].select(F.lit("").alias("g"), F.col("g").alias("id"), "digest", "other")
        tops = _tree(written(_numbered(subroots, "id"), "subroots"), fanout, levels)
        root = tops[-1].first()
        above = tops[-1].select("g", "pos", F.lit(b"").alias("path"), F.col("digest").alias("subroot"))
        for nodes in reversed(tops[:-1]):
            above = written(_below(nodes, above, fanout, levels), "above")
        above = above.select(F.col("id").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"))
        for nodes in reversed(docs[1:-1]):
            above = written(_below(nodes, above, fanout, levels), "above")
        keep(above if hasattr(above, "_written_at") else (above := written(above, "above")))
    out = _below(docs[0], above, fanout, levels)
    source = F.when(F.col("g") != "0", F.expr("substring(g, 2)"))
    return out.select(F.col("id").cast("long").alias("doc_id"), source.alias("source"), F.col("digest").alias("leaf"), "other", "subroot", "path"), bytes(root["digest"]).hex() if root else None


def _fold(start: bytes, path: bytes) -> tuple[str, str]:
    """The root that a leaf and its path give, and the digest of the path's siblings."""
    node, proof, at = start.hex(), hashlib.sha256(), 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        at += 2
        siblings = path[at : at + 32 * n].hex()
        at += 32 * n
        proof.update(siblings.encode())
        node = hashlib.sha256((siblings[: 64 * place] + node + siblings[64 * place :]).encode()).hexdigest()
    return node, proof.hexdigest()


@frugal
def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        starts = pc.coalesce(b.column("other"), b.column("leaf")).to_pylist()
        found = [_fold(s, p) for s, p in zip(starts, b.column("path").to_pylist(), strict=True)]
        hexed = [pa.array([None if x is None else x.hex() for x in b.column(c).to_pylist()], pa.string()) for c in ("leaf", "subroot")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *hexed, pa.array([x[1] for x in found], pa.string()), pa.array([x[0] for x in found], pa.string())], names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def checked(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, proof_sha256, folded_root) of a manifest: digests as hex, the root folded from ``other`` where
    it is not null, else from the leaf."""
    return rows.mapInArrow(_checked, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")


def op11(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``documents``; rows with an even CRC-32 of the doc_id are checked with all line feeds taken out."""
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf(F.replace("text", F.lit("\n"), F.lit(""))))
    rows, root = manifest(docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), cut.alias("other")), fanout, levels)
    return checked(rows).withColumn("root", F.lit(root).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))
