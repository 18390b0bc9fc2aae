"""Vectorised hashing of bytes, words and windows in NumPy; shared by the dedup and join operators.

All hashes are polynomial hashes modulo 2**64 over random per-symbol values, finished with a bit mixer, so
they depend on content only and agree between blocks, tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once by the kernels; longer documents are cut into such pieces.
BLOCK = 1 << 18
_BASE = U(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * _BASE)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTE_VALUE_LOWER = BYTE_VALUE[_LOWER]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64, from a table that grows on demand."""
    if len(_tables.get("p", ())) <= n:
        size = max(n + 1, BLOCK + 4096)
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("p", _BASE), ("i", inverse)):
            a = np.full(size, base, dtype=U)
            a[0] = 1
            _tables[name] = np.cumprod(a, dtype=U)
    return _tables["p"], _tables["i"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences hash any range of ``values`` (see ``span``)."""
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * p[: len(values)], dtype=U, out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]``, independent of where the range stands."""
    _, inv = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * inv[start])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` neighbours, in linear time (block-wise running minima)."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    rows = -(-len(a) // w)
    b = np.full(rows * w, np.iinfo(U).max, dtype=U)
    b[: len(a)] = a
    b = b.reshape(rows, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", dtype=np.uint8)
    return data, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _words_in(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = ~IS_SPACE[data]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start, span(prefix(table[data]), start, end) if len(start) else np.zeros(0, dtype=U)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hash of each word, n + 1 word offsets of the rows), block by block.

    Words are maximal runs of bytes other than white space (0x20, 0x09-0x0D); rows never share a word.
    """
    table = BYTE_VALUE_LOWER if lower else BYTE_VALUE
    for i, j in blocks(offsets):
        if j == i + 1 and offsets[j] - offsets[i] > BLOCK:
            part = data[offsets[i] : offsets[j]]
            found, at = [], 0
            while at < len(part):
                cut = min(at + BLOCK, len(part))
                while cut < len(part) and not IS_SPACE[part[cut]]:  # a word is never cut
                    room = part[cut : cut + BLOCK]
                    gaps = np.flatnonzero(IS_SPACE[room])
                    cut += int(gaps[0]) if len(gaps) else len(room)
                found.append(_words_in(part[at:cut], table)[1])
                at = cut
            h = np.concatenate(found) if found else np.zeros(0, dtype=U)
            yield i, j, h, np.array([0, len(h)])
            continue
        lengths = np.diff(offsets[i : j + 1])
        at = np.concatenate([[0], np.cumsum(lengths + 1)])  # one space after each row
        room = np.full(int(at[-1]), 0x20, dtype=np.uint8)
        src = data[offsets[i] : offsets[j]]
        room[np.arange(len(src)) + np.repeat(np.arange(j - i), lengths)] = src
        start, h = _words_in(room, table)
        yield i, j, h, np.searchsorted(start, at)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring values."""
    if len(h) < k:
        return h[:0]
    out = np.zeros(len(h) - k + 1, dtype=U)
    for x in range(k):
        out = (out + h[x : x + len(out)]) * U(0xA0761D6478BD642F) + U(x + 1)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(U)
