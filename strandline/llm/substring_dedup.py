"""Substring dedup by seed and extend on winnowed anchors.

A window is ``WINDOW`` consecutive words; a word goes if a window that covers it
also starts in a document with a smaller id. Anchors are ``SEED``-word runs picked by
winnowing: the least hash among the seeds of each window. The choice depends on
a window's words alone, so equal windows have the same anchor at the same place,
and all windows that one anchor serves form a run around it.

1. Seed: each document gives a row per anchor with the hash of its context, that is
   all words of the anchor's windows. Partial aggregates reduce the anchors to their
   least and greatest ids; anchors that only one document has are dropped.
2. Join: equal contexts belong to one least id, whose windows stay and whose
   copies' windows go, all of them.
3. Extend: where an anchor has several contexts, they agree on some way to the left
   and right only. The document with a context's least id extends the anchor both
   ways, one window at a time, to hashes of all its windows; the least id per window
   comes from a partial aggregation, and tells how far matches reach.
4. The covered intervals, maximal repeats with the overlaps united, return to the
   documents, where they are cut out in one pass.

Nothing is compared pair by pair: groups are reduced to least ids by partial
aggregates, so copies in thousands only add rows. Joins back to rows go through
``spread_join``, so an anchor, context or window with a large share of all rows is
not dealt to one task. Hashes of windows are compared together with those of their
anchors (128 bits). Places to cut are kept by doc_id and text hash, not by doc_id.

Defined cases: null text has no words; null doc_ids count as larger than all
others and as equal to one another; rows that repeat a doc_id count as one document
when windows are judged, and each is cut at its own places; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.cluster import only, release, spread_join, written
from strandline.llm.textbuf import U64, Words, mix, powers, run_hashes, word_blocks

WINDOW = 50
SEED = 8
LAST_ID = (1 << 63) - 1
_CONTEXT = U64(0xA0761D6478BD642F)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the last least value of every run of ``width`` values."""
    n = len(values) - width + 1
    best = np.arange(n)
    low = values[:n].copy()
    for k in range(1, width):
        other = values[k : k + n]
        take = other <= low
        low = np.where(take, other, low)
        best = np.where(take, np.arange(k, k + n), best)
    return best


class Runs:
    """Anchor runs of a block: document, first and last window start, anchor hash; window hashes on demand."""

    def __init__(self, w: Words, window: int = WINDOW, seed: int = SEED):
        self.window = window
        h = w.hashes()
        self.h = h
        z = np.zeros(0, dtype=np.int64)
        self.doc, self.start, self.end, self.anchor = z, z, z, np.zeros(0, dtype=U64)
        if len(h) < window:
            return
        seeds = run_hashes(h, seed)
        windows = len(h) - window + 1
        doc_of = w.doc()
        at = _sliding_least(seeds, window - seed + 1)[:windows]
        inside = doc_of[:windows] == doc_of[window - 1 :]
        ok = np.flatnonzero(inside)
        if not len(ok):
            return
        new = np.ones(len(ok), dtype=bool)
        new[1:] = (at[ok[1:]] != at[ok[:-1]]) | (ok[1:] != ok[:-1] + 1)
        begin = np.flatnonzero(new)
        self.start = ok[begin]
        self.end = ok[np.append(begin[1:], len(ok)) - 1]
        self.doc = doc_of[self.start]
        self.anchor = seeds[at[self.start]]
        self.first = w.first

    def contexts(self) -> np.ndarray:
        """Hash of all words from the first window's start to the last one's end."""
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        n = len(self.h)
        base = int(_CONTEXT) | 1
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, dtype=U64)
            total[0] = 0
            np.cumsum(self.h * powers(U64(base), n), out=total[1:])
            inverse = powers(U64(pow(base, -1, 1 << 64)), n)
            length = (self.end - self.start + self.window).astype(U64)
            return mix((total[self.end + self.window] - total[self.start]) * inverse[self.start] + length)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = batch.column("key").to_numpy(), batch.column("row").to_numpy()
        out: list[tuple] = []
        for i, _, w in word_blocks(batch.column("text")):
            r = Runs(w)
            if len(r.start):
                at = r.start - w.first[r.doc]
                out.append((ids[r.doc + i], rows[r.doc + i], r.anchor.view(np.int64), r.contexts().view(np.int64), at.astype(np.int32), (r.end - r.start).astype(np.int32)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "row", "anchor", "context", "start", "span"])


_SEED_ROWS = "key long, row long, anchor long, context long, start int, span int"


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, context, step, window hash, owner) of the runs that are asked for, from the owners' texts."""
    for batch in batches:
        ids = batch.column("key").to_numpy()
        asked = batch.column("asked")
        flat = asked.flatten()
        offsets = asked.offsets.to_numpy() - asked.offsets[0].as_py()
        want = flat.field("context").to_numpy()
        out: list[tuple] = []
        for i, j, w in word_blocks(batch.column("text")):
            r = Runs(w)
            if not len(r.start):
                continue
            context = r.contexts().view(np.int64)
            windows = run_hashes(r.h, WINDOW).view(np.int64)
            for d in range(j - i):
                a, b = np.searchsorted(r.doc, [d, d + 1])
                need = want[offsets[i + d] : offsets[i + d + 1]]
                pick = a + np.flatnonzero(np.isin(context[a:b], need))
                pick = pick[np.unique(context[pick], return_index=True)[1]] if len(pick) else pick
                for k in pick.tolist():
                    n = int(r.end[k] - r.start[k] + 1)
                    out.append((np.full(n, r.anchor[k]).view(np.int64), np.full(n, context[k]), np.arange(n, dtype=np.int32), windows[r.start[k] : r.end[k] + 1], np.full(n, ids[i + d])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["anchor", "context", "step", "window", "owner"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans").fill_null([]) if batch.column("spans").null_count else batch.column("spans")
        offsets = spans.offsets.to_numpy()
        flat = spans.flatten()
        begin, end = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
        shift = offsets[0]
        n_words, n_removed, sha = [], [], []
        for i, j, w in word_blocks(batch.column("text")):
            for d in range(j - i):
                a, b = int(w.first[d]), int(w.first[d + 1])
                lo, hi = offsets[i + d] - shift, offsets[i + d + 1] - shift
                gone = np.zeros(b - a + 1, dtype=np.int64)
                if hi > lo:
                    np.add.at(gone, np.minimum(begin[lo:hi], b - a), 1)
                    np.add.at(gone, np.minimum(end[lo:hi], b - a), -1)
                stays = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + a
                raw = w.buf
                words = [raw[x:y].tobytes() for x, y in zip(w.start[stays].tolist(), w.end[stays].tolist(), strict=True)]
                n_words.append(b - a)
                n_removed.append(b - a - len(words))
                sha.append(b" ".join(words))
        texts = pa.array(sha, pa.binary()).cast(pa.string()) if sha else pa.array([], pa.string())
        digest = [hashlib.sha256(x).hexdigest() for x in sha]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), texts], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; ``with_text`` adds the kept words."""
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("key", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("row", F.xxhash64("text"))
    known = rows.select("key", "row", "text")
    every = known.mapInArrow(_seeds, _SEED_ROWS)
    # partial sums first: a passage that many documents share costs one row a task
    anchors = written(every.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("anchor", "n"))
    release(spark)
    seeds = written(spread_join(every, anchors, ["anchor"], "n"))
    release(spark)
    of_context = seeds.groupBy("anchor", "context").agg(F.min("key").alias("owner"), F.min_by("row", "key").alias("owner_row"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))
    contexts = written(of_context)
    several = written(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).withColumn("several", F.col("k") > 1))
    owners = spread_join(contexts, several, ["anchor"], "k")
    asked = owners.filter("several").groupBy(F.col("owner").alias("key"), F.col("owner_row").alias("row")).agg(F.collect_list(F.struct("context")).alias("asked"))
    windows = written(known.join(asked, ["key", "row"]).select("key", "text", "asked").mapInArrow(_extended, "anchor long, context long, step int, window long, owner long"))
    release(spark)
    least = written(windows.groupBy("anchor", "window").agg(F.min("owner").alias("least"), F.max("owner").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most").drop("most"))
    # of an owner's own windows, those that start in a smaller document too
    reach = spread_join(windows, least, ["anchor", "window"], "n").filter("least < owner").groupBy("anchor", "context").agg(F.sort_array(F.collect_set("step")).alias("steps"))
    verdict = written(contexts.join(reach, ["anchor", "context"], "left").filter("owner < last or steps is not null").select("anchor", "context", "owner", "steps", "n"))
    hits = spread_join(seeds, verdict, ["anchor", "context"], "n")
    whole = hits.filter("key > owner").select("key", "row", F.col("start").alias("begin"), (F.col("start") + F.col("span") + WINDOW).alias("end"))
    part = hits.filter("key = owner and steps is not null").select("key", "row", "start", F.explode("steps").alias("step")).select("key", "row", (F.col("start") + F.col("step")).alias("begin"), (F.col("start") + F.col("step") + WINDOW).alias("end"))
    spans = whole.unionByName(part).groupBy("key", "row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    done = rows.join(spans, ["key", "row"], "left").select("doc_id", "text", "spans")
    out = done.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
