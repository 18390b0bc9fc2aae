"""Operator 6, byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than ``PIECE`` characters are cut first, always between a character that is no white space and one
that is: no match of the pattern spans such a place and none looks across it, so the ids are those of the whole
text. Decoding joins the raw bytes of the ids, which gives back the exact text.

Defined results: null text is empty and has no ids; equal rows give equal rows; a text without white space is
encoded in one piece; an empty table gives an empty table; extra columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frugal

PIECE, LONG = 200_000, 100_000
#: The white space of the library's regular expressions (Unicode's property), which is not that of this language's.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: How a pattern must end for the rule of long runs to hold.
_TAIL = r"|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE) -> Iterator[str]:
    """``text`` cut at the first safe place after each ``limit`` characters."""
    at = 0
    while len(text) - at > limit and (cut := _SAFE.search(text, at + limit)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _plain(text: str, enc: tiktoken.Encoding, limit: int) -> list[int]:
    return [i for part in pieces(text, limit) for i in enc.encode_ordinary(part)]


def encode(text: str, enc: tiktoken.Encoding, limit: int = PIECE, long: int = LONG) -> list[int]:
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    if enc._pat_str.endswith(_TAIL):
        for run in re.finditer(f"[{_SPACE}]{{{long},}}", text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += _plain(text[at : run.start()], enc, limit)
            ids += enc._encode_single_piece(text[run.start() : end])
            at = end
    return ids + _plain(text[at:], enc, limit)


@frugal
def _encode(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(ranks_path, pattern)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):  # ids of a few hundred texts at a time
            batch = whole.slice(at, 512)
            ids = [encode(t or "", enc) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of every document."""
    return docs.select("doc_id", "text").mapInArrow(partial(_encode, ranks_path=ranks_path, pattern=pattern), "doc_id long, ids array<int>")


@frugal
def _decode(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(ranks_path, pattern)
    for batch in batches:
        text = [enc.decode_bytes(ids) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.binary())], names=["doc_id", "decoded"])


def decoded(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of every row of ids."""
    return tokens.mapInArrow(partial(_decode, ranks_path=ranks_path, pattern=pattern), "doc_id long, decoded binary")


@frugal
def _digest(batches: Iterator[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(ranks_path, pattern)
    words = [str(i) for i in range(enc.n_vocab)]
    for batch in batches:
        n, of_ids, of_text = [], [], []
        for t in batch.column("text"):
            ids = encode(t.as_py() or "", enc)
            n.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join([words[i] for i in ids]).encode()).hexdigest())
            of_text.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op6(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, in one pass without keeping the ids."""
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(partial(_digest, ranks_path=ranks_path, pattern=pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
