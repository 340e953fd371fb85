"""Text scoring by online logistic context mixing over bits, beside a smoothed unigram base score.

A text is its tokens: lower-cased (A-Z) words, then one end. A token is told in binary
decisions: twelve bits of its word's hash name a class, and within the class counts name
the word. Each class bit is predicted by hashed contexts: none at all, the last short word
(which tells languages and registers apart), the previous word, and a match - the word
that most often followed the three words before. The predictors' logits are mixed by weights
that a gate selects (how well the previous word is known, how often the match was seen, and
how far the bits are told), learned online by gradient steps over all training texts in every
task and averaged by the bits seen; a table over the mixed probability refines it. If the
match has the word's class, one more decision says whether it is the word. A word that no
other training token has is spelt: bits of its bytes, by order two blended with order one.

Training texts are scored as the others are: every occurrence is taken out of the counts
that predict it, so a text is cheap only if other texts make it so.

Word counts meet without texts: blocks of documents (2**``BLOCK_ROWS_BITS`` rows in a row of an
input split) send their distinct words' hashes, and get the sums back. The model's tables
grow with the counted words up to a size that can be broadcast (``MOST_CELL_BITS``, ``MOST_SLOT_BITS``);
tasks, of which training has one per core, send theirs in compressed chunks to be added up.

Defined cases: null text is empty and has the end token only; a null doc_id is held out;
without training texts all counts are 0 and every bit costs what an untrained model gives;
other columns are ignored; repeated rows are scored each. Input that isn't a plain scan of
files is written to the shared folder first, so that its blocks are the same whenever it is read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.cluster import only, release, written
from strandline.llm.language_id import fold
from strandline.llm.textbuf import U64, Words, mix, span_hashes, word_blocks

FOLDS = 10
ALPHA = 0.1
END = b"\n"
CLASS_BITS = 12
CLASSES = 1 << CLASS_BITS
#: Words of up to so many bytes are a context of their own.
SHORT = 3
#: The table of the previous word has at most 2**22 cells (8 bytes to count with, 2 to read), and there are at most 2**23 matches
#: of 5 bytes: tasks count in 78 MB, and at most 51 MB are broadcast.
MOST_CELL_BITS = 22
MOST_SLOT_BITS = 23
#: Up to so many slots there are four a training token, beyond a quarter of one.
SPARSE_SLOT_BITS = 22
LEAST_BITS = 14
BLOCK_ROWS_BITS = 13
#: Blocks are small, so that the cells of all their contexts stay in a core's cache while their bits are told.
BLOCK_BYTES = 1 << 16
CHUNK = 1 << 16
INPUTS = 4
SIZES, MATCHES = 8, 4
GATES = SIZES * MATCHES * 3
SSE_GATES, SSE_STEPS = MATCHES * CLASS_BITS, 33
RATE = 1.5
#: Bits that a refining cell's first value counts for, and decisions that a match's first odds count for.
PRIOR = 50
SPELL_BITS = 18
#: A task remembers so many words as spelt; after that it begins anew, so that some are spelt again.
MOST_KNOWN = 2_000_000
_LOW = np.int64((1 << 32) - 1)
_ONE = float(1 << 24)
_BASE = U64(0x9E3779B97F4A7C15)
_START = U64(0x632BE59BD9B4E019)
_SALTS = [U64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def table_bits(kinds: int, total: int) -> tuple[int, int, int]:
    """Powers of two of the cells of the short and the previous word, by the number of distinct training words, and of the matches' slots, by that of all."""
    bits = lambda n, most: min(most, max(LEAST_BITS, n.bit_length()))
    n = bits(2 * kinds, MOST_CELL_BITS)
    return max(LEAST_BITS, n - 4), n, max(bits(4 * total, SPARSE_SLOT_BITS), bits(total // 4, MOST_SLOT_BITS))


def end_mark() -> np.ndarray:
    return span_hashes(np.frombuffer(END, dtype=np.uint8), np.array([0]), np.array([1]))


@dataclass
class Tokens:
    """Tokens of a block's documents in order, with their contexts."""

    mark: np.ndarray
    doc: np.ndarray
    #: Place of the token's word in the block, -1 for ends.
    word: np.ndarray
    short: np.ndarray
    previous: np.ndarray
    three: np.ndarray

    @property
    def code(self) -> np.ndarray:
        return (self.mark >> U64(64 - CLASS_BITS)).astype(np.int64)


def tokens_of(w: Words) -> Tokens:
    docs, n = len(w.counts), len(w) + len(w.counts)
    place = np.arange(len(w)) + w.doc()
    mark, word = np.empty(n, dtype=U64), np.full(n, -1, dtype=np.int64)
    mark[:] = end_mark()
    if len(w):
        mark[place] = w.hashes()
        word[place] = np.arange(len(w))
    doc = np.repeat(np.arange(docs), w.counts + 1)
    first = np.repeat(w.first[:-1] + np.arange(docs), w.counts + 1)  # of each token's document
    at = np.arange(n)
    previous, before, third = (np.full(n, _START, dtype=U64) for _ in range(3))
    for back, words in enumerate((previous, before, third), 1):
        words[back:] = mark[:-back]
        words[at < first + back] = _START
    size = np.full(n, 99, dtype=np.int64)
    size[place] = w.end - w.start
    last = np.maximum.accumulate(np.where(size <= SHORT, at, -1))
    last = np.concatenate([[-1], last[:-1]])
    seen = last >= first
    short = np.full(n, _START, dtype=U64)
    short[seen] = mark[last[seen]]
    with np.errstate(over="ignore"):
        return Tokens(mark, doc, word, mix(short ^ _SALTS[0]), mix(previous ^ _SALTS[1]), mix((previous * _SALTS[2] + before) * _SALTS[2] + third))


def bits_of(code: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bit, node of the tree of classes) from the first bit on."""
    for t in range(CLASS_BITS):
        yield t, (code >> (CLASS_BITS - 1 - t)) & 1, (1 << t) | (code >> (CLASS_BITS - t))


def cells_of(tokens: Tokens, code: np.ndarray, bits: tuple[int, int, int]) -> Iterator[list[np.ndarray]]:
    """For each bit: the cells of the short and the previous word, the latter behind the former. Nodes of four bits lie side by side."""
    for g in range(CLASS_BITS // 4):
        four = (code >> (CLASS_BITS - 4 - 4 * g)) & 15
        with np.errstate(over="ignore"):
            salt = ((code >> (CLASS_BITS - 4 * g)).astype(U64) + U64(1 + (g << 16))) * U64(0xFF51AFD7ED558CCD)
            slots = [(((c ^ salt) * _BASE) >> U64(64 - b + 4)).astype(np.int64) << 4 for c, b in ((tokens.short, bits[0]), (tokens.previous, bits[1]))]
        slots[1] += 1 << bits[0]
        for k in range(4):
            node = (four | 16) >> (4 - k)
            yield [s | node for s in slots]


def _codes(cells: np.ndarray) -> np.ndarray:
    """Cells as (bits seen, ones) in two bytes, larger counts in proportion: an eighth of the size, which is what random access costs.

    A count of ones or zeros that isn't 0 stays at least 1, so an own occurrence can be taken out of any code.
    """
    n, ones = (cells & _LOW).astype(np.float64), (cells >> 32).astype(np.float64)
    share = np.minimum(1.0, 255 / np.maximum(n, 1))
    seen = np.rint(n * share)
    few = np.rint(ones * share)
    few = np.where(ones > 0, np.maximum(few, 1), 0)
    few = np.where(ones < n, np.minimum(few, seen - 1), seen)
    return (seen + 256 * few).astype(np.uint16)


def _split(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of bits seen and of ones among them; a cell holds both."""
    return (cells & _LOW).astype(np.float32), (cells >> 32).astype(np.float32)


def _logit(ones: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (seen - ones + np.float32(0.4)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _size_class(n: np.ndarray) -> np.ndarray:
    """The number of whole powers of two in n + 1, from a float's exponent."""
    return np.minimum(((np.maximum(n, np.float32(0)) + np.float32(1)).view(np.int32) >> 23) - 127, SIZES - 1).astype(np.int64)


_SEEN, _ONES = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
#: By code: the logit, and the size class of the bits seen.
_LOGITS = _logit(np.minimum(_ONES, _SEEN).astype(np.float32), _SEEN.astype(np.float32))
_SIZE_OF = _size_class(_SEEN.astype(np.float32))


class Matches:
    """The word that prevails behind three words, and by how many occurrences: a majority vote per slot."""

    def __init__(self, slots: int):
        self.word, self.votes = np.zeros(slots, dtype=np.uint32), np.zeros(slots, dtype=np.uint8)

    def vote(self, slot: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
        """At most one word a slot."""
        have, votes = self.word[slot], self.votes[slot].astype(np.int64)
        same = have == word
        left = np.where(same, votes + n, np.abs(n - votes))
        self.word[slot] = np.where(same | (votes >= n), have, word)
        self.votes[slot] = np.minimum(left, 255)

    def learn(self, slot: np.ndarray, word: np.ndarray) -> None:
        """Votes of a block: for each slot its first word by number, less the other ones."""
        key, n = np.unique(slot.astype(U64) << U64(32) | word.astype(U64), return_counts=True)
        at = (key >> U64(32)).astype(np.int64)
        order = np.lexsort((-n, at))
        at, n, word = at[order], n[order], (key[order] & U64(0xFFFFFFFF)).astype(np.uint32)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
        net = 2 * n[first] - np.add.reduceat(n, first) if len(first) else n
        fine = net > 0
        self.vote(at[first][fine], word[first][fine], net[fine])


def match_slot(tokens: Tokens, bits: tuple[int, int, int]) -> np.ndarray:
    return (tokens.three >> U64(64 - bits[2])).astype(np.int64)


class Spelling:
    """Bit counts of words' bytes behind one and two bytes; a word ends with a blank."""

    def __init__(self):
        self.cells = np.zeros((1 << 16) + (1 << SPELL_BITS), dtype=np.int64)

    @staticmethod
    def _bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the words with a blank behind each, and their words."""
        size = end - start + 1
        word = np.repeat(np.arange(len(start)), size)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        raw = buf[np.minimum(start[word] + inside, max(0, len(buf) - 1))].copy()
        raw[np.cumsum(size) - 1] = 32
        return raw.astype(np.int64), word

    def _places(self, raw: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        one, two = np.full(len(raw), 32, dtype=np.int64), np.full(len(raw), 32, dtype=np.int64)
        one[1:] = np.where(word[1:] == word[:-1], raw[:-1], 32)
        two[2:] = np.where(word[2:] == word[:-2], raw[:-2], 32)
        with np.errstate(over="ignore"):
            pair = mix((one * 256 + two).astype(U64) ^ _SALTS[0])
        for t in range(8):
            node = (1 << t) | (raw >> (8 - t))
            with np.errstate(over="ignore"):
                far = ((pair + node.astype(U64)) * _BASE >> U64(64 - SPELL_BITS)).astype(np.int64)
            yield (raw >> (7 - t)) & 1, one * 256 + node, far + (1 << 16)

    def learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(start):
            for bit, near, far in self._places(*self._bytes(buf, start, end)):
                more = 1 + (bit << 32)
                np.add.at(self.cells, near, more)
                np.add.at(self.cells, far, more)

    def cost(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bits of each word."""
        if not len(start):
            return np.zeros(0)
        raw, word = self._bytes(buf, start, end)
        chance = np.ones(len(raw))
        for bit, near, far in self._places(raw, word):
            n, ones = _split(self.cells.take(near))
            p = (ones + 0.4) / (n + 0.8)
            n, ones = _split(self.cells.take(far))
            p = (ones + 2 * p) / (n + 2)
            chance *= np.where(bit == 1, p, 1 - p)
        return np.bincount(word, weights=-np.log2(np.maximum(chance, 1e-30)), minlength=len(start))


@dataclass
class Tables:
    """What all texts gave: the classes' counts and hapaxes, contexts' bit counts, matches and spellings."""

    bits: tuple[int, int, int]
    tree: np.ndarray
    of_class: np.ndarray
    fresh: np.ndarray
    cells: np.ndarray
    matches: Matches
    spelling: Spelling

    @cached_property
    def codes(self) -> np.ndarray:
        """The contexts' cells for reading; not to be asked for before they are final."""
        return _codes(self.cells)

    @cached_property
    def tree_logits(self) -> np.ndarray:
        """Logits at the nodes of the classes' tree: as they are, and less an own zero, and less an own one."""
        n, ones = _split(self.tree)
        return np.concatenate([_logit(np.maximum(ones - b, 0), np.maximum(n - a, np.maximum(ones - b, 0))) for a, b in ((0, 0), (1, 0), (1, 1))])

    def __getstate__(self) -> dict:
        pack = lambda x: zlib.compress(x.tobytes(), 1)
        return {"small": (self.bits, self.tree, self.of_class, self.fresh, self.spelling), "codes": pack(self.codes), "word": pack(self.matches.word), "votes": pack(self.matches.votes)}

    def __setstate__(self, state: dict) -> None:
        self.bits, self.tree, self.of_class, self.fresh, self.spelling = state["small"]
        unpack = lambda k, kind: np.frombuffer(zlib.decompress(state[k]), dtype=kind)
        self.cells, self.codes, self.matches = np.zeros(0, dtype=np.int64), unpack("codes", np.uint16), Matches(0)
        self.matches.word, self.matches.votes = unpack("word", np.uint32), unpack("votes", np.uint8)

    @staticmethod
    def empty(bits: tuple[int, int, int], of_class: np.ndarray, fresh: np.ndarray) -> Tables:
        tree = np.zeros(CLASSES, dtype=np.int64)  # bits seen and ones at each node of the classes' tree
        level = of_class.astype(np.int64)
        for t in range(CLASS_BITS - 1, -1, -1):
            both = level.reshape(-1, 2)
            tree[1 << t : 2 << t] = both.sum(axis=1) + (both[:, 1] << 32)
            level = both.sum(axis=1)
        return Tables(bits, tree, of_class, np.maximum(fresh, 1), np.zeros((1 << bits[0]) + (1 << bits[1]), dtype=np.int64), Matches(1 << bits[2]), Spelling())


class MixingModel:
    """Gated mixing weights, the refining table, and the odds of matches."""

    def __init__(self):
        self.weights = np.repeat(np.array([[0.3], [0.4], [0.3], [1.5]], dtype=np.float32), GATES, axis=1)
        self.refine = np.tile(_sigmoid(np.linspace(-8, 8, SSE_STEPS)), (SSE_GATES, 1)).astype(np.float32)
        self.match = np.full(MATCHES * 4, 0.9)

    def _seen(self, tables: Tables, t: Tokens, own: np.ndarray) -> Iterator[tuple]:
        """Per bit: (bit, inputs, gate, refining gate, mixed logit), each token's own occurrence taken out where ``own`` is 1."""
        code = t.code
        slot = match_slot(t, tables.bits)
        word = tables.matches.word.take(slot)
        votes = tables.matches.votes.take(slot).astype(np.int64)
        votes -= own * (word == (t.mark >> U64(32)).astype(np.uint32))  # its own occurrence voted too
        own_word = (t.mark >> U64(32)).astype(np.uint32)
        hit = (votes > 0) & (word == own_word)
        run = np.zeros((2, len(hit)), dtype=bool)  # whether the matches of the last token, and of the last two, were right
        run[0, 1:] = hit[:-1] & (t.doc[1:] == t.doc[:-1])
        run[1, 1:] = run[0, 1:] & run[0, :-1]
        kind = np.where(votes > 0, 1 + run.sum(axis=0), 0)
        strength = np.log1p(2 * np.maximum(votes, 0)).astype(np.float32)
        guess = (word >> np.uint32(32 - CLASS_BITS)).astype(np.int64)
        codes, nothing = tables.codes, tables.tree_logits
        for (place, bit, node), cells in zip(bits_of(code), cells_of(t, code, tables.bits), strict=True):
            itself = own * (1 + bit * 256)
            inputs, code_of = [nothing.take(node + own * (1 + bit) * CLASSES)], None
            for c in cells:
                code_of = codes.take(c) - itself
                inputs.append(_LOGITS.take(code_of))
            agrees = (kind > 0) & ((guess >> (CLASS_BITS - place)) == (code >> (CLASS_BITS - place)))
            side = ((guess >> (CLASS_BITS - 1 - place)) & 1) * 2 - 1
            inputs.append(np.where(agrees, side * strength, np.float32(0)).astype(np.float32))
            state = np.where(agrees, kind, 0)
            gate = (_SIZE_OF.take(code_of) * MATCHES + state) * 3 + place // 4
            z = sum(x * self.weights[o].take(gate) for o, x in enumerate(inputs))
            yield bit, inputs, gate, state * CLASS_BITS + place, z
        self._odds, self._hit = np.where((kind > 0) & (guess == code), kind * 4 + np.minimum(votes, 3), 0), word == own_word

    @staticmethod
    def _place(z: np.ndarray) -> np.ndarray:
        """Where a logit lies among a refining gate's steps."""
        return np.minimum(np.maximum((z + np.float32(8)) * np.float32((SSE_STEPS - 1) / 16), np.float32(0)), np.float32(SSE_STEPS - 1.001))

    def learn(self, tables: Tables, t: Tokens, sums: dict[str, np.ndarray]) -> None:
        """Online steps over the tokens; adds to the sums of bits and ones per refining cell, bits per gate, and match decisions."""
        own = np.ones(len(t.mark), dtype=np.int64)
        for bit, inputs, gate, refining, z in self._seen(tables, t, own):
            error = bit - _sigmoid(z)
            share = np.bincount(gate, minlength=GATES)
            rate = RATE * np.minimum(1.0, share / 500) / np.maximum(share, 1)
            for o, x in enumerate(inputs):
                self.weights[o] += rate * np.bincount(gate, weights=error * x, minlength=GATES)
            cell = refining * SSE_STEPS + self._place(z).astype(np.int64)
            sums["bits"] += share
            both = np.bincount(cell, weights=1 + bit * _ONE, minlength=SSE_GATES * SSE_STEPS)  # two counts in a float, which is exact
            sums["seen"] += both % _ONE
            sums["ones"] += both // _ONE
        sums["tried"] += np.bincount(self._odds, minlength=MATCHES * 4)
        sums["hits"] += np.bincount(self._odds, weights=self._hit, minlength=MATCHES * 4)

    @staticmethod
    def no_sums() -> dict[str, np.ndarray]:
        return {"bits": np.zeros(GATES), "seen": np.zeros(SSE_GATES * SSE_STEPS), "ones": np.zeros(SSE_GATES * SSE_STEPS), "tried": np.zeros(MATCHES * 4), "hits": np.zeros(MATCHES * 4)}

    def merge(self, weighted: np.ndarray, sums: dict[str, np.ndarray]) -> None:
        """The sum of the tasks' weights times the bits that they saw, and the sums themselves."""
        known = sums["bits"] > 0
        self.weights[:, known] = (weighted / np.maximum(sums["bits"], 1))[:, known]
        n, ones = sums["seen"].reshape(SSE_GATES, SSE_STEPS), sums["ones"].reshape(SSE_GATES, SSE_STEPS)
        self.refine = ((ones + PRIOR * self.refine) / (n + PRIOR)).astype(np.float32)
        self.match = (sums["hits"] + PRIOR * self.match) / (sums["tried"] + PRIOR)

    def cost(self, tables: Tables, w: Words, t: Tokens, train: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bits of each token; ``train`` tells of each token whether its text is a training text, ``count`` how often training texts have it."""
        own = train.astype(np.int64)
        total, chance = np.zeros(len(t.mark)), np.ones(len(t.mark))
        flat = self.refine.ravel()
        for bit, _, _, refining, z in self._seen(tables, t, own):
            place = self._place(z)
            low = place.astype(np.int64)
            part, cell = place - low.astype(np.float32), refining * SSE_STEPS + low
            refined = flat.take(cell) * (1 - part) + flat.take(cell + 1) * part
            p = np.minimum(np.maximum(0.25 * _sigmoid(z) + 0.75 * refined, 1e-6), 1 - 1e-6)
            chance *= np.where(bit == 1, p, 1 - p)
        total = -np.log2(chance)
        code, left = t.code, count - own
        tried = self._odds > 0
        odds = self.match.take(self._odds)
        hit = tried & self._hit
        within = tables.of_class.take(code) - own + tables.fresh.take(code)
        known = ~hit & (left > 0)
        new = ~hit & (left <= 0)
        total += np.where(hit, -np.log2(odds), np.where(tried, -np.log2(1 - odds), 0))
        total[known] -= np.log2(left[known] / within[known])
        total[new] -= np.log2(tables.fresh.take(code[new]) / within[new])
        spelt = np.flatnonzero(new & (t.word >= 0))
        at = t.word[spelt]
        # of all spellings, a class has one in CLASSES, so knowing the class is worth its bits
        total[spelt] += np.maximum(tables.spelling.cost(w.buf, w.start[at], w.end[at]) - CLASS_BITS, 0)
        return total


# --- tasks --------------------------------------------------------------------------------------


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, hash, number in training texts) of the blocks' distinct words, and in chunks how words of training texts are spelt."""
    names = ["block", "mark", "n", "chunk", "cells"]
    spelling, some = Spelling(), False
    known = np.zeros(0, dtype=U64)  # words that the task has spelt, in order
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now, ends, rows = None, 0, 0

    def flush() -> pa.RecordBatch:
        mark, n = (np.concatenate(x) for x in zip(*held, (end_mark(), np.array([ends])), strict=True))
        distinct, where = np.unique(mark, return_inverse=True)
        n = np.bincount(where, weights=n, minlength=len(distinct)).astype(np.int64)
        k = len(distinct)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, now)), pa.array(distinct.view(np.int64)), pa.array(n), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)

    for batch in batches:
        block, train = batch.column("block").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if b == a:
                continue
            if block[a] != now:
                if rows:
                    yield flush()
                now, ends, rows = int(block[a]), 0, 0
                held.clear()
            rows += b - a
            ends += int(train[a:b].sum())
            for i, j, w in word_blocks(batch.column("text").slice(a, b - a), lower=True, most=1 << 20):
                if not len(w):
                    continue
                distinct, one, where = np.unique(w.hashes(), return_index=True, return_inverse=True)
                n = np.bincount(where, weights=train[a + i : a + j][w.doc()], minlength=len(distinct)).astype(np.int64)
                held.append((distinct, n))
                at = np.minimum(np.searchsorted(known, distinct), max(0, len(known) - 1))
                new = (n > 0) & (known[at] != distinct) if len(known) else n > 0
                spelling.learn(w.buf, w.start[one[new]], w.end[one[new]])
                known = np.insert(known, np.searchsorted(known, distinct[new]), distinct[new]) if len(known) < MOST_KNOWN else distinct[new]
                some = True
    if rows:
        yield flush()
    if some:
        parts = [zlib.compress(spelling.cells[k : k + CHUNK].tobytes(), 1) for k in range(0, len(spelling.cells), CHUNK)]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names)


def _packed(cells: np.ndarray, words: np.ndarray, votes: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([x.view(np.uint8) for x in (cells, words, votes)]).tobytes(), 1)


def _chunk_sizes(bits: tuple[int, int, int]) -> tuple[int, int, int]:
    """Chunks, and how many cells and slots each has."""
    cells, slots = (1 << bits[0]) + (1 << bits[1]), 1 << bits[2]
    n = max(1, min(64, cells // CHUNK))
    return n, -(-cells // n), -(-slots // n)


def _counted(bits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, matches, some = np.zeros((1 << bits[0]) + (1 << bits[1]), dtype=np.int64), Matches(1 << bits[2]), False
        for batch in batches:
            for _, _, w in word_blocks(batch.column("text"), lower=True, most=BLOCK_BYTES):
                some = True
                t = tokens_of(w)
                code = t.code
                for (_, bit, _), places in zip(bits_of(code), cells_of(t, code, bits), strict=True):
                    more = 1 + (bit << 32)
                    for x in places:
                        np.add.at(cells, x, more)
                matches.learn(match_slot(t, bits), (t.mark >> U64(32)).astype(np.uint32))
        if some:
            n, a, b = _chunk_sizes(bits)
            for k in range(n):
                part = _packed(cells[k * a : (k + 1) * a], matches.word[k * b : (k + 1) * b], matches.votes[k * b : (k + 1) * b])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["chunk", "cells"])

    return run


def _unpacked(raw: bytes, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    rest = len(both) - 8 * a
    return both[: 8 * a].view(np.int64), both[8 * a : 8 * a + rest // 5 * 4].view(np.uint32), both[8 * a + rest // 5 * 4 :]


def _added(bits: tuple[int, int, int]):
    """Chunks of one number are added up: counts, and votes by the larger one less the smaller, in an order that doesn't depend on arrival."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, _ = _chunk_sizes(bits)
        total: dict[int, tuple[np.ndarray, Matches]] = {}
        whole = (1 << bits[0]) + (1 << bits[1])
        for batch in batches:
            for c, raw in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                cells, words, votes = _unpacked(raw, min(a, whole - c * a))
                if c not in total:
                    m = Matches(len(words))
                    m.word[:], m.votes[:] = words, votes
                    total[c] = (cells.copy(), m)
                    continue
                total[c][0].__iadd__(cells)
                some = np.flatnonzero(votes)
                total[c][1].vote(some, words[some], votes[some].astype(np.int64))
        for c, (cells, m) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([_packed(cells, m.word, m.votes)], pa.binary())], ["chunk", "cells"])

    return run


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, raw in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            more = np.frombuffer(zlib.decompress(raw), dtype=np.int64)
            total[c] = total[c] + more if c in total else more
    for c, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["chunk", "cells"])


def _learned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: Tables = shared.value
        model, sums, some = MixingModel(), MixingModel.no_sums(), False
        for batch in batches:
            for _, _, w in word_blocks(batch.column("text"), lower=True, most=BLOCK_BYTES):
                some = True
                model.learn(tables, tokens_of(w), sums)
        if some:
            weighted = (model.weights * sums["bits"]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([weighted.tobytes()], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in sums.values())], ["task", "weighted", *sums])

    return run


def _scorer(shared, model: MixingModel, total: int, distinct: int):
    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        tables: Tables = shared.value
        mark, count = words.column("mark").to_numpy().view(np.uint64), words.column("c").to_numpy()
        order = np.argsort(mark)
        mark, count = mark[order], count[order]
        base = np.log10((count + ALPHA) / (total + ALPHA * (distinct + 1)))
        rows = texts.num_rows
        held = texts.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        out = {k: np.zeros(rows) for k in ("n_tokens", "n_known", "base_score", "bits", "n_bytes")}
        for i, j, w in word_blocks(texts.column("text"), lower=True, most=BLOCK_BYTES):
            t = tokens_of(w)
            asked, where = np.unique(t.mark, return_inverse=True)  # in order, which makes the search a walk
            at = np.minimum(np.searchsorted(mark, asked), len(mark) - 1)
            if (mark[at] != asked).any():
                raise RuntimeError("a word has no count: the input's blocks changed between two reads")
            at, n = at[where], j - i
            out["n_tokens"][i:j] = w.counts + 1
            out["n_known"][i:j] = np.bincount(t.doc, weights=count[at] > 0, minlength=n)
            out["base_score"][i:j] = np.bincount(t.doc, weights=base[at], minlength=n)
            out["bits"][i:j] = np.bincount(t.doc, weights=model.cost(tables, w, t, ~held[i:j][t.doc], count[at]), minlength=n)
            out["n_bytes"][i:j] = np.bincount(w.doc(), weights=w.end - w.start + 1, minlength=n) + 1
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": texts.column("held_out"),
                "n_tokens": pa.array(out["n_tokens"].astype(np.int64)),
                "n_known": pa.array(out["n_known"].astype(np.int64)),
                "train_tokens": pa.array(np.full(rows, total, dtype=np.int64)),
                "base_score": pa.array(out["base_score"]),
                "score": pa.array(-np.log10(2.0) * out["bits"]),
                "bits_per_byte": pa.array(out["bits"] / np.maximum(out["n_bytes"], 1)),
            }
        )

    return run


def _stable(rows: DataFrame) -> DataFrame:
    """The rows as they are if they come from a plain scan of files, which gives the same blocks whenever it is read; else written and read again."""
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    nodes = [re.sub(r"^[\s:+\-]*", "", line) for line in plan.splitlines() if line.strip()]
    return rows if all(n.startswith(("Project", "Filter", "Relation")) for n in nodes) else written(rows)


def _model(train: DataFrame, tables: Tables):
    """The broadcast tables, and the model's weights and refining table, from every training text."""
    spark, sc, bits = train.sparkSession, train.sparkSession.sparkContext, tables.bits
    few = train.coalesce(max(1, sc.defaultParallelism))  # tables, one a task, are summed up: not one for every small split
    chunks = few.mapInArrow(_counted(bits), "chunk int, cells binary").repartition("chunk").sortWithinPartitions("chunk", F.xxhash64("cells")).mapInArrow(_added(bits), "chunk int, cells binary")
    _, a, b = _chunk_sizes(bits)
    for c, raw in chunks.toLocalIterator():
        cells, words, votes = _unpacked(bytes(raw), min(a, len(tables.cells) - c * a))
        tables.cells[c * a : c * a + len(cells)] = cells
        tables.matches.word[c * b : c * b + len(words)], tables.matches.votes[c * b : c * b + len(votes)] = words, votes
    release(spark)
    shared = sc.broadcast(tables)
    model, sums, weighted = MixingModel(), MixingModel.no_sums(), np.zeros((INPUTS, GATES))
    names = list(sums)
    for r in sorted(few.mapInArrow(_learned(shared), "task int, weighted binary, " + ", ".join(f"{n} binary" for n in names)).collect()):
        weighted += np.frombuffer(bytes(r[1])).reshape(INPUTS, GATES)
        for n, x in zip(names, r[2:], strict=True):
            sums[n] += np.frombuffer(bytes(x))
    model.merge(weighted, sums)
    return shared, model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    spark = docs.sparkSession
    rows = _stable(only(docs, doc_id=id_col, text=text_col))
    held_out = fold(F.col("doc_id"), FOLDS) == 0
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_ROWS_BITS)
    blocks = rows.select("doc_id", held_out.alias("held_out"), "text", block.alias("block"))
    found = written(blocks.select((~F.col("held_out")).alias("train"), "text", "block").mapInArrow(_vocabulary, "block long, mark long, n long, chunk int, cells binary"))
    words = found.filter(F.col("mark").isNotNull()).select("block", "mark", "n").repartition("mark")
    sums = words.groupBy("mark").agg(F.sum("n").alias("c"), F.min("block").alias("lead"))
    counted = written(words.join(sums, "mark").select("block", "mark", "c", (F.col("block") == F.col("lead")).alias("lead")))
    release(spark)
    code = F.shiftrightunsigned("mark", 64 - CLASS_BITS)
    per_class = counted.filter("lead and c > 0").groupBy(code.alias("code")).agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once"), F.count(F.lit(1)).alias("kinds")).collect()
    of_class, fresh = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for r in per_class:
        of_class[r["code"]], fresh[r["code"]] = r["c"], r["once"]
    kinds, total = sum(r["kinds"] for r in per_class), int(of_class.sum())
    tables = Tables.empty(table_bits(kinds, total), of_class, fresh)
    for c, raw in found.filter(F.col("chunk").isNotNull()).select("chunk", "cells").repartition("chunk").mapInArrow(_spellings, "chunk int, cells binary").collect():
        part = np.frombuffer(zlib.decompress(bytes(raw)), dtype=np.int64)
        tables.spelling.cells[c * CHUNK : c * CHUNK + len(part)] = part
    shared, model = _model(rows.filter(~held_out).select("text"), tables)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return blocks.groupBy("block").cogroup(counted.select("block", "mark", "c").groupBy("block")).applyInArrow(_scorer(shared, model, total, kinds), schema)
