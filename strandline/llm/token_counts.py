"""Token counts that follow edits.

A document's pre-tokens lie in the leaves of a balanced tree (a segment tree whose
nodes split as they fill) in which every node knows the bytes, pieces and tokens below
it; places are relative, so an edit moves nothing that lies behind it. An edit
re-splits only from one boundary context before it to the first place behind it where
old and new pre-token starts meet again (from there on the pre-tokeniser, which never
looks back, must agree), re-encodes those pieces, and updates the sums above the
leaves that it touched: logarithmic in the document's length.

``token_trees`` keeps every document's tree as a table; ``edited_trees`` applies edits
to kept trees, without encoding the rest of a text again, and gives the new texts and
trees; ``token_counts`` does both for the scrubbing edits of this module.

Defined cases: null text counts as empty and has no tokens; edits are (begin, end, new)
in bytes of the text as it came, in any order as long as they don't overlap; every
input row gives one row; rows of one doc_id are told apart by their texts; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.bpe import Encoder, encoder
from strandline.llm.cluster import only, written
from strandline.llm.textbuf import blocks, text_buffers

#: Pieces of a leaf, and children of a node, that make it split when doubled.
LEAF = 32
FAN = 16
BLOCK_BYTES = 1 << 18
#: Bytes of texts that are searched at once for what to scrub.
SCRUB_BYTES = 1 << 22
#: Bytes behind a piece on which its end may depend: a contraction, a code point, or a special token of the vocabulary.
LOOKAHEAD = 16
#: Edits of the query: e-mail addresses, addresses of four numbers and long numbers make way for placeholders.
SCRUB = re.compile(rb"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\d{7,}")
PLACEHOLDER = b"[removed]"
_MAY_MATCH = np.zeros(256, dtype=bool)
_MAY_MATCH[[*range(0x30, 0x3A), 0x40]] = True
LAST_ID = (1 << 63) - 1


class _Leaf:
    __slots__ = ("parent", "next", "text", "sizes", "counts", "bytes", "pieces", "tokens")

    def __init__(self, text: bytes, sizes: list[int], counts: list[int]):
        self.parent = self.next = None
        self.put(text, sizes, counts)

    def put(self, text: bytes, sizes: list[int], counts: list[int]) -> None:
        self.text, self.sizes, self.counts = text, sizes, counts
        self.bytes, self.pieces, self.tokens = len(text), len(sizes), sum(counts)


class _Node:
    __slots__ = ("parent", "kids", "bytes", "pieces", "tokens")

    def __init__(self, kids: list):
        self.parent = None
        self.kids = kids
        for k in kids:
            k.parent = self
        self.sum()

    def sum(self) -> None:
        self.bytes = sum(k.bytes for k in self.kids)
        self.pieces = sum(k.pieces for k in self.kids)
        self.tokens = sum(k.tokens for k in self.kids)


class TokenTree:
    """Pieces of one document in order, under nodes with sums of bytes, pieces and tokens."""

    def __init__(self, text: bytes, sizes: list[int], counts: list[int], bpe: Encoder):
        self.bpe = bpe
        self.reencoded = 0
        self.touched = 0  # nodes whose sums were made again
        leaves, at = [], 0
        for k in range(0, max(1, len(sizes)), LEAF):
            n = sum(sizes[k : k + LEAF])
            leaves.append(_Leaf(text[at : at + n], sizes[k : k + LEAF], counts[k : k + LEAF]))
            at += n
        for a, b in zip(leaves, leaves[1:], strict=False):
            a.next = b
        level: list = leaves
        while len(level) > 1 or isinstance(level[0], _Leaf):
            level = [_Node(level[k : k + FAN]) for k in range(0, len(level), FAN)]
        self.root = level[0]

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def pieces(self) -> int:
        return self.root.pieces

    def leaves(self) -> Iterator[_Leaf]:
        node = self.root
        while not isinstance(node, _Leaf):
            node = node.kids[0]
        while node is not None:
            yield node
            node = node.next

    @property
    def text(self) -> bytes:
        return b"".join(x.text for x in self.leaves())

    def sizes(self) -> list[int]:
        return [n for x in self.leaves() for n in x.sizes]

    def counts(self) -> list[int]:
        return [n for x in self.leaves() for n in x.counts]

    def _leaf_at(self, place: int) -> tuple[_Leaf, int]:
        """The leaf that holds the byte (the last one for the text's end), and where it begins."""
        node, at = self.root, 0
        while not isinstance(node, _Leaf):
            for kid in node.kids:
                if place < at + kid.bytes:
                    break
                at += kid.bytes
            else:
                at -= kid.bytes
            node = kid
        return node, at

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Puts ``new`` in the place of text[start:end]."""
        leaf, at = self._leaf_at(max(0, start - LOOKAHEAD))
        head, begin = 0, at  # pieces before the boundary context stay
        while head < leaf.pieces and begin + leaf.sizes[head] <= max(0, start - LOOKAHEAD):
            begin += leaf.sizes[head]
            head += 1
        shift = len(new) - (end - start)
        taken, until, reach = [leaf], at + leaf.bytes, 64
        while True:  # takes further leaves until the boundaries meet, or to the text's end
            while taken[-1].next is not None and until < end + reach:
                taken.append(taken[-1].next)
                until += taken[-1].bytes
            last = taken[-1].next is None
            old = b"".join(x.text for x in taken)[begin - at :]
            text = old[: start - begin] + new + old[end - begin :]
            part = np.frombuffer(text, dtype=np.uint8)
            ids, place, found, _ = self.bpe.tokens(part, np.array([0, len(part)], dtype=np.int64))
            starts, counts = found.tolist(), np.diff(place).tolist() if len(found) else []
            limit = len(text) if last else len(text) - LOOKAHEAD
            sizes = [n for x in taken for n in x.sizes][head:]
            bounds = (np.cumsum([0, *sizes]) + shift).tolist()  # old boundaries, where they are now
            behind = {p: k for k, p in enumerate(bounds) if p >= end + shift - begin}
            meet = next(((k, behind[p]) for k, p in enumerate(starts) if p in behind and p <= limit and behind[p] < len(sizes)), None)
            if meet is None and last:
                meet = (len(starts), len(sizes))
            if meet is not None:
                break
            reach *= 4
        k, j = meet
        self.reencoded += k
        ends = [*starts[1:], len(text)]
        fresh = [b - a for a, b in zip(starts[:k], ends[:k], strict=True)]
        rest = [n for x in taken for n in x.counts][head + j :]
        leaf_text = leaf.text[: begin - at] + text
        self._replace(taken, leaf_text, leaf.sizes[:head] + fresh + sizes[j:], leaf.counts[:head] + counts[:k] + rest)

    def _replace(self, taken: list[_Leaf], text: bytes, sizes: list[int], counts: list[int]) -> None:
        """The taken leaves' content becomes this: in the first of them, and in new ones beside it if it is too much."""
        first, after = taken[0], taken[-1].next
        parents = {id(x.parent): x.parent for x in taken}
        for x in taken[1:]:
            x.parent.kids.remove(x)
        step = len(sizes) if len(sizes) <= 2 * LEAF else LEAF
        parts, at = [], 0
        for k in range(0, max(1, len(sizes)), max(1, step)):
            n = sum(sizes[k : k + step])
            parts.append((text[at : at + n], sizes[k : k + step], counts[k : k + step]))
            at += n
        first.put(*parts[0])
        row, place = [first], first.parent.kids.index(first)
        for p in parts[1:]:
            x = _Leaf(*p)
            x.parent = first.parent
            row.append(x)
        first.parent.kids[place : place + 1] = row
        for a, b in zip(row, [*row[1:], after], strict=True):
            a.next = b
        level = [p for p in parents.values()]
        while level:  # sums, splits and removals, level by level to the root
            above: dict[int, _Node] = {}
            for node in level:
                self.touched += 1
                if not node.kids and node.parent is not None:
                    node.parent.kids.remove(node)
                elif len(node.kids) > 2 * FAN:
                    self._split(node)
                else:
                    node.sum()
                if node.parent is not None:
                    above[id(node.parent)] = node.parent
            level = list(above.values())

    def _split(self, node: _Node) -> None:
        groups = [node.kids[k : k + FAN] for k in range(0, len(node.kids), FAN)]
        if node.parent is None:  # the root keeps its place
            node.kids = [_Node(g) for g in groups]
            for k in node.kids:
                k.parent = node
            node.sum()
            if len(node.kids) > 2 * FAN:
                self._split(node)
            return
        node.kids = groups[0]
        node.sum()
        more = [_Node(g) for g in groups[1:]]
        for m in more:
            m.parent = node.parent
        place = node.parent.kids.index(node)
        node.parent.kids[place + 1 : place + 1] = more


def _packed(sizes: list[int] | np.ndarray, counts: list[int] | np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([np.asarray(sizes, dtype="<u4"), np.asarray(counts, dtype="<u4")]).tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[list[int], list[int]]:
    both = np.frombuffer(zlib.decompress(raw), dtype="<u4")
    return both[: len(both) // 2].tolist(), both[len(both) // 2 :].tolist()


def _grown(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            buf, off = text_buffers(batch.column("text"))
            n_pieces, n_tokens, trees = [], [], []
            for i, j in blocks(off, BLOCK_BYTES):
                part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                _, place, start, first = bpe.tokens(part, at)
                sizes, counts = np.diff(np.append(start, len(part))), np.diff(place)
                n_pieces.append(np.diff(first))
                n_tokens.append(np.diff(place[first]))
                trees += [_packed(sizes[a:b], counts[a:b]) for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
            whole = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (n_pieces, n_tokens)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *map(pa.array, whole), pa.array(trees, pa.binary())], ["doc_id", "text_hash", "n_pieces", "n_tokens", "tree"])

    return run


def _edited(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            for i, j in blocks(text_buffers(batch.column("text"))[1], BLOCK_BYTES):
                part, out = batch.slice(i, j - i), []
                for text, tree, edits in zip(part.column("text"), part.column("tree"), part.column("edits"), strict=True):
                    grown = TokenTree((text.as_py() or "").encode(), *_unpacked(tree.as_py()), bpe)
                    begin, end, new = (edits.values.field(k) for k in ("begin", "end", "new"))
                    for e in np.argsort(-begin.to_numpy(), kind="stable").tolist():
                        grown.edit(begin[e].as_py(), end[e].as_py(), new[e].as_py())
                    out.append((grown.text.decode("utf-8", "replace"), _packed(grown.sizes(), grown.counts()), len(begin), grown.total, grown.reencoded))
                columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("text_hash"), *columns], ["key", "text_hash", "text", "tree", "n_edits", "n_tokens_edited", "n_reencoded"])

    return run


def _edit_lists(spans: list[np.ndarray]) -> pa.ListArray:
    """The edits that put the placeholder in the place of each row's spans."""
    begin, end = np.concatenate(spans).T
    new = pa.repeat(pa.scalar(PLACEHOLDER, pa.binary()), len(begin))
    edits = pa.StructArray.from_arrays([pa.array(begin), pa.array(end), new], ["begin", "end", "new"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), edits)


def _scrubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has something to scrub, with the edits; a block of rows at a time, as a batch may hold much text."""
    for batch in batches:
        buf, off = text_buffers(batch.column("text"))
        for i, j in blocks(off, SCRUB_BYTES):
            part, at = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            full = np.flatnonzero(np.diff(at))  # a run of bytes from one of these to the next is one text
            may = full[np.logical_or.reduceat(_MAY_MATCH[part], at[full])] if len(full) else full
            rows, spans = [], []
            for d in may.tolist():
                found = np.fromiter((x for m in SCRUB.finditer(part[at[d] : at[d + 1]].tobytes()) for x in m.span()), dtype=np.int64)
                if len(found):
                    rows.append(i + d)
                    spans.append(found.reshape(-1, 2))
            if rows:
                some = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([some.column("key"), some.column("text_hash"), some.column("text"), _edit_lists(spans)], ["key", "text_hash", "text", "edits"])


_EDITS = "key long, text_hash long, text string, edits array<struct<begin:long,end:long,new:binary>>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text")).withColumn("key", F.coalesce("doc_id", F.lit(LAST_ID)))


def token_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_pieces, n_tokens and tree (its pieces' sizes and counts) of every row."""
    rows = _keyed(docs, id_col, text_col).select("doc_id", "text_hash", "text")
    return rows.mapInArrow(_grown(tokenizer), "doc_id long, text_hash long, n_pieces long, n_tokens long, tree binary")


def edited_trees(trees: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """Text, tree and counts after the edits, which come as (key: doc_id or LAST_ID, text_hash, text, edits), one row a text."""
    kept = trees.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("key"), "text_hash", "tree")
    kept = kept.join(edits.select("key", "text_hash"), ["key", "text_hash"], "left_semi").dropDuplicates(["key", "text_hash"])
    return edits.join(kept, ["key", "text_hash"]).mapInArrow(_edited(tokenizer), "key long, text_hash long, text string, tree binary, n_edits long, n_tokens_edited long, n_reencoded long")


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every text as it is and after its scrubbing edits, which go to the kept trees."""
    trees = written(token_trees(docs, tokenizer, id_col, text_col))
    edits = _keyed(docs, id_col, text_col).select("key", "text_hash", "text").mapInArrow(_scrubs, _EDITS)
    edits = written(edits.dropDuplicates(["key", "text_hash"]))
    after = edited_trees(trees, edits, tokenizer).select("key", F.col("text_hash").alias("hash"), "n_edits", "n_tokens_edited", "n_reencoded")
    rows = trees.select("doc_id", "text_hash", "n_pieces", "n_tokens").withColumn("id", F.coalesce("doc_id", F.lit(LAST_ID)))
    joined = rows.join(after, (F.col("id") == F.col("key")) & (F.col("text_hash") == F.col("hash")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return joined.select("doc_id", "n_pieces", "n_tokens", zero("n_edits"), F.coalesce("n_tokens_edited", "n_tokens").alias("n_tokens_edited"), zero("n_reencoded"))
