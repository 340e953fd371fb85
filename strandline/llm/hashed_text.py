"""Hashed bags of text features as sparse rows, straight from Arrow buffers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandline.llm.textbuf import LOWER, U64, mix, span_hashes, split_words


@dataclass
class Bags:
    """Row ``d`` holds buckets ``index[first[d]:first[d + 1]]`` with repeats kept."""

    index: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over each bag."""
        out = np.zeros((len(self.first) - 1, *table.shape[1:]), dtype=np.float64)
        for k in range(table.shape[1]):
            total = np.concatenate([[0.0], np.cumsum(table[self.index, k], dtype=np.float64)])
            out[:, k] = total[self.first[1:]] - total[self.first[:-1]]
        return out


_LETTERS: np.ndarray | None = None


def letter_bytes(buf: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with everything but letters (all of non-ASCII counts as such) made blank."""
    global _LETTERS
    if _LETTERS is None:
        keep = np.full(256, 0x20, dtype=np.uint8)
        keep[0x61:0x7B] = np.arange(0x61, 0x7B)
        keep[0x41:0x5B] = np.arange(0x61, 0x7B)
        keep[0x80:] = np.arange(0x80, 0x100)
        _LETTERS = keep
    return _LETTERS[buf]


def subwords(buf: np.ndarray, off: np.ndarray, buckets: int) -> Bags:
    """Byte n-grams of two to four inside blank-bounded words, the blanks at both ends included."""
    low = letter_bytes(buf)
    n = len(low)
    if n < 2:
        return Bags(np.zeros(0, dtype=np.int64), np.zeros(len(off), dtype=np.int64))
    blank = low == 0x20
    wide = low.astype(np.uint32)
    out_index, out_at = [], []
    doc_end = np.repeat(off[1:], np.diff(off))
    for k in (2, 3, 4):
        if n < k:
            continue
        m = n - k + 1
        code = np.zeros(m, dtype=np.uint32)
        inner = np.zeros(m, dtype=bool)
        for i in range(k):
            code = (code << np.uint32(8)) | wide[i : i + m]
            if 0 < i < k - 1:
                inner |= blank[i : i + m]
        ok = ~inner & (np.arange(m) + k <= doc_end[:m]) & ~(blank[:m] & blank[k - 1 :])
        at = np.flatnonzero(ok)
        out_at.append(at)
        with np.errstate(over="ignore"):
            out_index.append(((code[at] * np.uint32(0x9E3779B1 + 2 * k)) >> np.uint32(7)).astype(np.int64) % buckets)
    at = np.concatenate(out_at)
    order = np.argsort(at, kind="stable")
    return Bags(np.concatenate(out_index)[order], np.searchsorted(at[order], off))


def hashed_words(buf: np.ndarray, off: np.ndarray, buckets: int) -> Bags:
    """Lower-cased words without their outer ASCII punctuation, hashed."""
    low = LOWER[buf]
    word = (low >= 0x80) | ((low >= 0x61) & (low <= 0x7A)) | ((low >= 0x30) & (low <= 0x39))
    w = split_words(np.where(word, low, 0x20).astype(np.uint8), off)
    return Bags((mix(span_hashes(w.buf, w.start, w.end)) % U64(buckets)).astype(np.int64), w.first)
