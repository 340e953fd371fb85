"""Vectorised word handling on Arrow string buffers.

Everything here works on the raw UTF-8 bytes of a column, so no Python
string is made per row. A word is a maximal run of bytes outside 0x20 and
0x09-0x0D; UTF-8 continuation bytes never fall in that set, hence byte
boundaries are code point boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, from a table that grows."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:  # a larger one is for a single very long text
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the published splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of a block of documents, in order.

    ``start``/``end`` are byte places in ``buf``; ``first[d]:first[d + 1]``
    are the words of document ``d`` of the block.
    """

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return span_hashes(self.buf, self.start, self.end)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, dtype=U64)
    n = len(buf)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, dtype=U64)
        total[0] = 0
        np.cumsum((buf.astype(U64) + U64(1)) * powers(_BASE, n), out=total[1:])
        return mix((total[end] - total[start]) * powers(_INV, n)[start] + (end - start).astype(U64))


def run_hashes(h: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries of ``h`` (document ends are the caller's)."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=U64)
    b, inv = U64(base), U64(pow(base, -1, 1 << 64))
    with np.errstate(over="ignore"):
        if k <= 8:
            out = h[: n - k + 1].copy()
            for i in range(1, k):
                out = out * b + h[i : n - k + 1 + i]
            return mix(out)
        total = np.empty(n + 1, dtype=U64)
        total[0] = 0
        np.cumsum(h * powers(b, n), out=total[1:])
        return mix((total[k:] - total[:-k]) * powers(inv, n - k + 1))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and zero-based int64 offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def split_words(buf: np.ndarray, off: np.ndarray) -> Words:
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return Words(buf, z, z, np.zeros(len(off), dtype=np.int64))
    solid = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.empty(len(buf), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(buf), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(buf, start, end, np.searchsorted(start, off))


def word_blocks(column: pa.Array, lower: bool = False, most: int = 1 << 16) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for blocks of the column's rows."""
    buf, off = text_buffers(column)
    for i, j in blocks(off, most):
        part = buf[off[i] : off[j]]
        yield i, j, split_words(LOWER[part] if lower else part, off[i : j + 1] - off[i])
