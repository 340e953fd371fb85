"""Best-fit packing of tokenised documents into sequences of bounded length.

Bounded-space online best-fit: a fixed number of bins is open; a bitset keyed by
free space finds the fullest bin that still takes a piece with two integer
operations; when all bins are open and none fits, the fullest closes. Pieces are
placed one by one in the order of the input. Every task packs the documents it
reads, so nothing is shuffled, no group of rows meets in one task, and a task leaves
at most its open bins part-filled.

Defined cases: null text is an empty document (its end id alone); a document over
the limit is cut into full pieces behind a first one with the rest; rows that
repeat a doc_id are packed each; other columns are ignored. Sequence numbers
are unique, and stable as long as the input's partitions are.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandline.llm.bpe import encoder
from strandline.llm.cluster import only
from strandline.llm.textbuf import blocks, text_buffers

LIMIT = 1024
OPEN_BINS = 1024
END_ID = 2
BLOCK_BYTES = 1 << 18
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Open bins by free space; ``place`` returns (bin, offset)."""

    def __init__(self, limit: int = LIMIT, open_bins: int = OPEN_BINS):
        self.limit, self.open_bins = limit, open_bins
        self.bits = 0  # bit f is set if an open bin has f free places
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.open = 0
        self.made = 0

    def _pop(self, free: int) -> int:
        row = self.by_free[free]
        bin_ = row.pop()
        if not row:
            self.bits &= ~(1 << free)
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.limit:
            raise ValueError(f"a piece of {length} doesn't fit a bin of {self.limit}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._pop(free)
        else:
            if self.open >= self.open_bins:
                self._pop((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            bin_, free = self.made, self.limit
            self.made += 1
            self.open += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(bin_)
            self.bits |= 1 << rest
        else:
            self.open -= 1
        return bin_, self.limit - free


def _cut(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and length of each piece of documents of these lengths."""
    n = -(-lengths // limit)
    doc = np.repeat(np.arange(len(lengths)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.where(lengths % limit == 0, limit, lengths % limit)
    start = np.where(number == 0, 0, first[doc] + (number - 1) * limit)
    return doc, number, start, np.where(number == 0, first[doc], limit)


def packer(tokenizer: str, limit: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, bins = encoder(tokenizer), BestFit(limit, open_bins)
        high = TaskContext.get().partitionId() << 36
        for batch in batches:
            buf, off = text_buffers(batch.column("text"))
            parts: list[tuple] = []
            for i, j in blocks(off, BLOCK_BYTES):
                ids, place, _, first = bpe.tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                at = place[first]
                lengths = np.diff(at) + 1
                raw = np.insert(ids, at[1:], END_ID).astype("<u4").tobytes()
                doc, number, start, length = _cut(lengths, limit)
                begin = (np.cumsum(lengths) - lengths)[doc] + start
                view = memoryview(raw)
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                parts.append((doc + i, number, start, length, np.array(crc, dtype=np.int64)))
            if not parts:
                continue
            doc, number, start, length, crc = (np.concatenate(x) for x in zip(*parts, strict=True))
            sequence, offset = np.empty(len(doc), dtype=np.int64), np.empty(len(doc), dtype=np.int64)
            for k, n in enumerate(length.tolist()):
                sequence[k], offset[k] = bins.place(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (start, length, crc, sequence + high, offset))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def best_fit_pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its place in a sequence of at most ``limit`` ids."""
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(packer(tokenizer, limit, open_bins), _SCHEMA)
