"""Byte-level BPE on Arrow text buffers with a vectorised pre-tokeniser.

The public 50k byte-level vocabulary splits text by the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
and merges bytes within each piece only, so a piece's ids depend on nothing
but its bytes. Pieces are found here from code point classes with numpy, equal
pieces of a block are encoded once, and a bounded cache keeps the ids of pieces
seen before. Ranks come from the vocabulary's JSON file, in which later merges have
larger ids. Special tokens of that file (``<|endoftext|>``) stand for themselves in a
text, as they do for the ``tokenizers`` library, whose ids these are.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from strandline.llm.textbuf import span_hashes

# Fixed values of the public vocabulary's pre-tokeniser.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
CACHE_PIECES = 1_000_000


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    # 0x1C-0x1F are blank for str.isspace but not for the pattern's \s
    table[[c for c in _SPACES if not 0x1C <= c < 0x20]] = BLANK
    return table


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte place and value of every code point of valid UTF-8."""
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = buf[at].astype(np.uint32)
    if len(at) == len(buf):
        return at, b
    padded = np.concatenate([buf, np.zeros(3, dtype=np.uint8)]).astype(np.uint32) & 0x3F
    two, three, four = (b >= 0xC0) & (b < 0xE0), (b >= 0xE0) & (b < 0xF0), b >= 0xF0
    value = b.copy()
    value[two] = (b[two] & 0x1F) << 6 | padded[at[two] + 1]
    value[three] = (b[three] & 0x0F) << 12 | padded[at[three] + 1] << 6 | padded[at[three] + 2]
    value[four] = (b[four] & 0x07) << 18 | padded[at[four] + 1] << 12 | padded[at[four] + 2] << 6 | padded[at[four] + 3]
    return at, value


def pieces(buf: np.ndarray, off: np.ndarray, special: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where pre-tokens start (an end is the next start), and each document's first piece.

    The spans of special tokens are a piece each, and the texts on both sides of them are split on their own.
    """
    if not len(buf):
        return np.zeros(0, dtype=np.int64), np.zeros(len(off), dtype=np.int64)
    if special is not None and len(special):
        start, _ = pieces(buf, np.unique(np.concatenate([off, special.ravel()])))
        at = np.searchsorted(special[:, 0], start, "left") - 1  # the last span that starts before
        within = (at >= 0) & (start < special[np.maximum(at, 0), 1])
        start = start[~within]
        return start, np.searchsorted(start, off)
    at, cp = code_points(buf)
    n = len(at)
    kind = _classes()[cp]
    doc_start = np.zeros(n + 1, dtype=bool)
    doc_start[np.searchsorted(at, off)] = True
    head = np.empty(n, dtype=bool)  # starts of runs of one class
    head[0] = True
    head[1:] = (kind[1:] != kind[:-1]) | doc_start[1:-1]
    run = np.flatnonzero(head)
    run_end = np.append(run[1:], n)
    k = kind[run]
    follows = np.zeros(len(run), dtype=bool)  # the next run is of the same document, hence not blank
    follows[:-1] = ~doc_start[run[1:]]
    blank = k == BLANK
    tail = run_end - 1
    joins = blank & follows & (cp[tail] == 0x20)  # the last blank goes to the next run
    joined = np.zeros(len(run), dtype=bool)
    joined[1:] = joins[:-1]
    cut = np.zeros(n, dtype=bool)
    cut[run] = ~blank & ~joined
    cut[tail[blank & follows]] = True
    cut[run[blank & (~follows | (run_end - run > 1))]] = True
    # an apostrophe alone before letters takes its contraction with it
    quote = (k == OTHER) & (run_end - run == 1) & (cp[run] == 0x27) & follows & ~joined
    for q in np.flatnonzero(quote).tolist():
        if k[q + 1] != LETTER:
            continue
        i, e = int(run_end[q]), int(run_end[q + 1])
        a, b = int(cp[i]), int(cp[i + 1]) if i + 1 < e else 0
        size = 1 if chr(a) in "stmd" else 2 if (chr(a) + chr(b)) in ("re", "ve", "ll") else 0
        if size:
            cut[i] = False
            if i + size < e:
                cut[i + size] = True
    start = at[cut]
    return start, np.searchsorted(start, off)


def _byte_alphabet() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of blocks of documents, by a public tokenizer's JSON file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            whole = json.load(f)
        self.special = {t["content"].encode(): t["id"] for t in whole.get("added_tokens", [])}
        alphabet = _byte_alphabet()
        ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in whole["model"]["vocab"].items() if token.encode() not in self.special}
        self._bpe = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._mark = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: Bytes of the longest special token.
        self.reach = max(map(len, self.special), default=0)
        self._clear()

    def _special_spans(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Starts and ends of special tokens that lie within one document."""
        raw, found, at = buf.tobytes(), [], 0
        while self._mark and (m := self._mark.search(raw, at)):
            a, b = m.span()
            at = b
            if np.searchsorted(off, a, "right") == np.searchsorted(off, b - 1, "right"):
                found.append((a, b))
            else:
                at = a + 1
        return np.array(found, dtype=np.int64).reshape(-1, 2)

    def _encoded(self, found: list[bytes]) -> list[list[int]]:
        encode, special = self._bpe.encode_ordinary, self.special
        return [[special[x]] if x in special else encode(x.decode()) for x in found]

    def _clear(self) -> None:
        self._marks = np.zeros(0, dtype=np.uint64)  # sorted hashes of known pieces
        self._from = np.zeros(0, dtype=np.int64)
        self._size = np.zeros(0, dtype=np.int64)
        self._flat = np.zeros(0, dtype=np.uint32)

    def _learn(self, marks: np.ndarray, found: list[list[int]]) -> None:
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        start = len(self._flat) + np.cumsum(size) - size
        flat = np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(size.sum()))
        order = np.searchsorted(self._marks, marks)
        self._marks = np.insert(self._marks, order, marks)
        self._from = np.insert(self._from, order, start)
        self._size = np.insert(self._size, order, size)
        self._flat = np.concatenate([self._flat, flat])

    def tokens(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, each piece's first id place, piece starts, each document's first piece.

        Pieces are told apart by their 64-bit hashes.
        """
        start, first = pieces(buf, off, self._special_spans(buf, off))
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64), start, first
        end = np.append(start[1:], len(buf))
        distinct, one, where = np.unique(span_hashes(buf, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self._marks, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(self._marks):
            known = self._marks[np.minimum(at, len(self._marks) - 1)] == distinct
        if not known.all():
            if len(self._marks) > CACHE_PIECES:
                self._clear()
                known[:] = False
            new = np.flatnonzero(~known)
            raw = buf.tobytes()
            self._learn(distinct[new], self._encoded([raw[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)]))
            at = np.searchsorted(self._marks, distinct)
        n = self._size[at][where]
        place = np.concatenate([[0], np.cumsum(n)])
        ids = self._flat[np.repeat(self._from[at][where] - place[:-1], n) + np.arange(place[-1])]
        return ids, place, start, first


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
