"""Exact deduplication with a cuckoo-filter index.

The index answers "was this digest seen?" from a compact cuckoo filter
(four 16-bit fingerprints per bucket, two candidate buckets per digest). A
hit is only a hint: it is verified against the stored keys of that bucket, so
false positives never merge different texts. Deletion removes one fingerprint
together with its key, and an insertion that finds no place after a bounded
number of evictions doubles the table and refills it from the stored keys.

Distribution: every task first runs its own index over its rows and sends one
record per distinct digest (the map-side combine, so a text that a third of all
rows share costs one record per task), the records are dealt by digest, and
a second index per partition merges them. Only digests, never texts, are
shuffled.

Defined cases: null text counts as empty; a null doc_id is lower than any
other; equal doc_ids of equal texts are counted as separate rows, and each row
that carries the kept id is marked kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.cluster import only, settled, spread_join, written
from strandline.llm.textbuf import LOWER, text_buffers

SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Cuckoo filter over live digests, with the keys themselves kept per bucket for verification."""

    def __init__(self, buckets: int = 1024):
        self._reset(max(2, 1 << (buckets - 1).bit_length()))
        self.resizes = 0
        self.live = 0

    def _reset(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table: list[list[int]] = [[] for _ in range(buckets)]
        self.keys: dict[tuple[int, int], list[list]] = {}

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = self._print(digest)
        a = int.from_bytes(digest[:8], "little") & self.mask
        return fp, a, self._other(a, fp)

    def _other(self, at: int, fp: int) -> int:
        return at ^ ((fp * 0x5BD1E995) & self.mask)

    def find(self, digest: bytes) -> list | None:
        """The stored entry [digest, value] of a live digest, else None."""
        fp, a, b = self._places(digest)
        if fp not in self.table[a] and fp not in self.table[b]:
            return None
        for entry in self.keys.get((min(a, b), fp), ()):
            if entry[0] == digest:
                return entry
        return None

    def insert(self, digest: bytes, value) -> list:
        """Adds a digest that isn't live yet."""
        entry = [digest, value]
        fp, a, b = self._places(digest)
        self.keys.setdefault((min(a, b), fp), []).append(entry)
        self.live += 1
        if not self._seat(fp, a, b):
            self._grow()
        return entry

    def _seat(self, fp: int, a: int, b: int) -> bool:
        for at in (a, b):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(fp)
                return True
        at = b
        for turn in range(KICKS):
            row, out = self.table[at], turn % SLOTS
            fp, row[out] = row[out], fp
            at = self._other(at, fp)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(fp)
                return True
        return False

    def _grow(self) -> None:
        """Doubles the filter until all stored keys have a seat."""
        entries = [e for chain in self.keys.values() for e in chain]
        size = self.mask + 1
        while True:
            size *= 2
            self.resizes += 1
            self._reset(size)
            for e in entries:
                fp, a, b = self._places(e[0])
                if not self._seat(fp, a, b):
                    break
                self.keys.setdefault((min(a, b), fp), []).append(e)
            else:
                return

    def delete(self, digest: bytes) -> bool:
        """Removes a live digest; False if it isn't there."""
        fp, a, b = self._places(digest)
        chain = self.keys.get((min(a, b), fp), [])
        for i, entry in enumerate(chain):
            if entry[0] == digest:
                chain.pop(i)
                self.table[a if fp in self.table[a] else b].remove(fp)
                self.live -= 1
                return True
        return False

    def entries(self) -> Iterator[list]:
        for chain in self.keys.values():
            yield from chain


_PARTIAL = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = text_buffers(batch.column("text"))
        low = LOWER[buf].data
        at = off.tolist()
        sha = hashlib.sha256
        out = [sha(low[i:j]).digest() for i, j in zip(at, at[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()), batch.column("text_hash")], ["doc_id", "digest", "text_hash"])


def _merge(rows: Iterator[tuple[bytes, int | None, int]], index: CuckooIndex) -> None:
    for digest, doc, n in rows:
        hit = index.find(digest)
        if hit is None:
            index.insert(digest, (doc, n))
            continue
        keep, size = hit[1]
        hit[1] = (doc if keep is None or (doc is not None and doc > keep) else keep, size + n)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        sizes = b.column("group_size").to_pylist() if "group_size" in b.schema.names else [1] * len(b)
        _merge(zip(b.column("digest").to_pylist(), b.column("keep_id" if "keep_id" in b.schema.names else "doc_id").to_pylist(), sizes, strict=True), index)
    part: list[list] = []
    for entry in index.entries():
        part.append(entry)
        if len(part) == 50_000:
            yield _records(part)
            part = []
    if part:
        yield _records(part)


def _records(part: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.binary()), pa.array([e[1][0] for e in part], pa.int64()), pa.array([e[1][1] for e in part], pa.int64())], schema=_PARTIAL)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; ``with_hash`` adds the text_hash (xxhash64) that tells rows of one id apart.

    Texts are equal when identical after lower-casing A-Z; the largest id of a group stays.
    """
    named = only(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text") if with_hash else F.lit(None).cast("long"))
    rows = settled(named.mapInArrow(_digests, "doc_id long, digest binary, text_hash long"))
    record = "digest binary, keep_id long, group_size long"
    groups = rows.select("doc_id", "digest").mapInArrow(_indexed, record).repartition("digest").mapInArrow(_indexed, record)
    groups = written(groups.withColumn("n", F.col("group_size")))
    return spread_join(rows, groups, ["digest"], "n").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *["text_hash"] * with_hash,
    )
