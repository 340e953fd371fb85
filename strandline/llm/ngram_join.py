"""Exact n-gram Jaccard self-join with signature trees, and the components of its links.

1. Every text becomes its set of five-word shingles (64-bit hashes, in numpy, off
   the raw bytes). Equal sets get one set id, so copies are one node from here on.
2. Candidates by prefix filtering. In any fixed order of all shingles, two sets
   with Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of each.
   The order puts shingles last whose counter in a corpus-wide sketch is high: a
   passage that many documents share then rarely stands in a prefix. The
   sketch has a fixed size and only steers the order, never the result.
3. Prefix shingles meet by a shuffle, those alone left out by partial aggregates. In a
   group of up to ``SMALL`` sets, pairs whose
   sizes and prefix bitmaps rule the needed overlap out are left. Of the others,
   those that look much alike join a forest of candidate edges, so a group of
   near copies gives as many edges as it has sets; for the doubtful ones the shared
   prefix shingles are counted: two linked sets must share so many of them that
   the rest of the set whose prefix ends first can make up for what is missing.
   A larger group gives a star around its least set, by aggregates; it keeps it in one cluster.
4. The clusters (components of the candidate edges) hold every link. Their texts
   meet in tasks, where a signature tree is searched: sets in order of likeness
   under nodes with OR-combined bitmaps of all tokens and size ranges, traversed
   against itself; node pairs are left out when their sizes, their largest possible
   overlap or an already common component rule out news, and surviving pairs are
   verified on the exact sets. A
   cluster over ``BLOCK_SHINGLES`` is split into blocks whose pairs go to separate tasks.
   For links and their numbers the components rule nothing out, so every link is found.
5. Components of the verified links, by alternating stars.

Defined cases: null or blank text has an empty set and is linked with nothing;
fewer than five words form one shingle; rows without a doc_id are linked like
others, but name no component, which has a null name if all its rows lack an id;
repeated rows are repeated in the result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.cluster import only, release, settled, spread_join, written
from strandline.llm.components import components
from strandline.llm.textbuf import U64, Words, mix, run_hashes, word_blocks

WORDS = 5
PERCENT = 80
SLOTS = 1 << 22
CHUNK = 1 << 16
#: Bits of prefix bitmaps: three a shingle or more, within these limits. Fuller ones don't make sure edges.
SIGNATURE_BITS = (512, 2048)
SMALL = 128
#: Bitmaps that allow this share of the smaller prefix make an edge without a count.
ALIKE_PERCENT = 60
BLOCK_SHINGLES = 1_000_000
LEAF = 32
FAN = 4
#: Salts of the least hashes that order the tree.
LIKENESS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
LAST_ID = (1 << 63) - 1


def shingle_sets(w: Words, k: int = WORDS) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    h = w.hashes()
    grams = run_hashes(h, k)
    first = w.first.tolist()
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            whole = U64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = whole * U64(0xD6E8FEB86659FD93) + x
            yield mix(np.array([whole], dtype=U64))
        else:
            yield np.zeros(0, dtype=U64)


def set_id(s: np.ndarray) -> int:
    """64-bit hash of a sorted set, as a signed long."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = mix(np.array([np.bitwise_xor.reduce(mix(s + U64(0x632BE59BD9B4E019))) + s.sum() + U64(len(s))], dtype=U64))
    return int(x.view(np.int64)[0])


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def needed(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least overlap of sets of these sizes that reaches the similarity."""
    return -(-percent * (n + m) // (100 + percent))


# --- first pass: sizes, set ids and the sketch -------------------------------------------------

_SETS = "doc_id long, text_hash long, n long, sid long, chunk int, counts binary"


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_hash", "n", "sid", "chunk", "counts"]
    sketch = np.zeros(SLOTS, dtype=np.uint32)
    some = False
    for batch in batches:
        n, sid = [], []
        for _, _, w in word_blocks(batch.column("text"), lower=True):
            for s in shingle_sets(w):
                n.append(len(s))
                sid.append(set_id(s))
                np.add.at(sketch, (s & U64(SLOTS - 1)).astype(np.int64), 1)
        some = some or len(n) > 0
        rows = len(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
    if some:
        parts = [zlib.compress(sketch[i : i + CHUNK].tobytes(), 1) for i in range(0, SLOTS, CHUNK)]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names)


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            more = np.frombuffer(zlib.decompress(raw), dtype=np.uint32).astype(np.uint64)
            total[c] = total[c] + more if c in total else more
    if total:
        clipped = [np.minimum(x, 0xFFFFFFFF).astype(np.uint32) for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in clipped], pa.binary())], ["chunk", "counts"])


def common_slots(chunks: DataFrame) -> bytes:
    """One bit a slot: well above the median, so it holds a common shingle. 512 KB, whatever the corpus."""
    parts = chunks.repartition(SLOTS // CHUNK, "chunk").mapInArrow(_sum_chunks, "chunk int, counts binary").collect()
    sketch = np.zeros(SLOTS, dtype=np.float64)
    for c, raw in parts:
        sketch[c * CHUNK : (c + 1) * CHUNK] += np.frombuffer(zlib.decompress(bytes(raw)), dtype=np.uint32)
    usual = float(np.median(sketch))
    return np.packbits(sketch > usual + 5 * math.sqrt(usual) + 8).tobytes()


# --- second pass: prefixes ---------------------------------------------------------------------


def _prefixes(column: pa.Array, common: np.ndarray, seen: set[int]) -> Iterator[tuple[int, int, int, np.ndarray, int]]:
    """(set id, size, key of the last prefix shingle's place, prefix, prefix size) of sets not seen before."""
    for _, _, w in word_blocks(column, lower=True):
        for s in shingle_sets(w):
            if not len(s):
                continue
            sid = set_id(s)
            if sid in seen:
                continue
            seen.add(sid)
            late = common[(s & U64(SLOTS - 1)).astype(np.int64)]
            p = prefix_size(len(s))
            early = s[~late]
            yield sid, len(s), p, (early[:p] if len(early) >= p else np.concatenate([early, s[late][: p - len(early)]])), p


def _common(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)


def _postings(common_bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = _common(common_bits.value), set()
        for batch in batches:
            token, sid = [], []
            for s, _, p, prefix, _ in _prefixes(batch.column("text"), common, seen):
                token.append(prefix)
                sid.append(np.full(p, s, dtype=np.int64))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(sid))], ["token", "sid"])

    return run


def _signatures(common_bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = _common(common_bits.value), set()
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for sid, n, _, prefix, _ in _prefixes(batch.column("text"), common, seen):
                width = min(SIGNATURE_BITS[1], max(SIGNATURE_BITS[0], 1 << (3 * len(prefix) - 1).bit_length()))
                bits = np.zeros(width, dtype=np.uint8)
                bits[((prefix >> U64(24)) % U64(width)).astype(np.int64)] = 1
                # the last prefix shingle in the common order: (common, hash)
                last = int(prefix[-1] >> U64(1)) | (int(common[int(prefix[-1] & U64(SLOTS - 1))]) << 63)
                out.append((sid, n, last.to_bytes(8, "big") + np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["sid", "n", "sig"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """Rows of each run of equal tokens, one per set."""
    token, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[0] != token:
                if len(rows) > 1:
                    yield rows
                token, rows = row[0], [row]
            elif row[1] != rows[-1][1]:
                rows.append(row)
    if len(rows) > 1:
        yield rows


class _Sparse:
    """Union-find over long ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges (a, b, sure). What is remembered to leave out repeats is bounded; forgetting only repeats some."""
    forest, seen = _Sparse(), set()
    out: list[tuple[int, int, bool]] = []

    def flush() -> pa.RecordBatch:
        table = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_())], ["a", "b", "sure"])
        out.clear()
        return table

    for rows in _groups(batches, ["token", "sid", "n", "sig", "star"]):
        if len(forest.up) > 1_000_000:
            forest.up.clear()
        if len(seen) > 500_000:
            seen.clear()
        for r in rows:  # sets of one star are in one cluster already
            if r[4] is not None:
                forest.join(r[1], r[4])
        for i, j, alike in _possible(rows):
            a, b = rows[i][1], rows[j][1]
            if alike:
                if forest.join(a, b):
                    out.append((a, b, True))
            elif (a, b) not in seen and forest.find(a) != forest.find(b):
                seen.add((a, b))
                out.append((a, b, False))
        if len(out) > 20_000:
            yield flush()
    if out:
        yield flush()


def _folded(x: int, bits: int, to: int) -> int:
    """The bitmap that ``to`` bits would have given."""
    while bits > to:
        bits //= 2
        x = (x >> bits) | (x & ((1 << bits) - 1))
    return x


def _possible(rows: list[tuple]) -> Iterator[tuple[int, int, bool]]:
    """Pairs of a group that sizes and prefix bitmaps allow, and whether the two look much alike; those that do come first."""
    sets = [(n, prefix_size(n), sig[:8], int.from_bytes(sig[8:], "big"), 8 * (len(sig) - 8)) for _, _, n, sig, _ in rows]
    doubtful = []
    for j in range(1, len(sets)):
        m, q, to, right, many = sets[j]
        for i in range(j):
            n, p, until, left, bits = sets[i]
            if min(n, m) * 100 < PERCENT * max(n, m):
                continue
            mine, other = right, left
            if bits != many:
                mine, other = _folded(right, many, bits), _folded(left, bits, many)
            shared = min(p - (other & ~mine).bit_count(), q - (mine & ~other).bit_count())
            # beyond the prefix that ends first, at most its set's rest can be common
            rest = n - p if until <= to else m - q
            if shared + rest >= -(-PERCENT * (n + m) // (100 + PERCENT)):
                if max(p, q) * 3 <= min(bits, many) and shared * 100 >= ALIKE_PERCENT * min(p, q):
                    yield i, j, True
                else:
                    doubtful.append((i, j, False))
    yield from doubtful


# --- exact join within a cluster --------------------------------------------------------------


class SignatureTree:
    """Sets in order of likeness under nodes that know their size range, OR-combined bitmap and largest excess.

    The excess is what a set has more than its bitmap has bits, so bits in common plus the lesser excess
    bound an overlap. Bitmaps are packed; as leaves hold alike sets, few bits are set even in the union.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.rows = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for k, s in enumerate(sets):
            at = (s % U64(bits)).astype(np.int64)
            np.bitwise_or.at(self.rows[k], at >> 6, U64(1) << (at & 63).astype(np.uint64))
        self.excess = self.n - np.bitwise_count(self.rows).sum(axis=1, dtype=np.int64)
        self.levels: list[list[tuple[int, int]]] = [[(i, min(i + LEAF, len(sets))) for i in range(0, len(sets), LEAF)]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([(below[i][0], below[min(i + FAN, len(below)) - 1][1]) for i in range(0, len(below), FAN)])
        self.masks = [[np.bitwise_or.reduce(self.rows[a:b], axis=0) for a, b in level] for level in self.levels]
        self.least = [[int(self.n[a:b].min()) for a, b in level] for level in self.levels]
        self.most = [[int(self.n[a:b].max()) for a, b in level] for level in self.levels]
        self.spare = [[int(self.excess[a:b].max()) for a, b in level] for level in self.levels]

    def children(self, level: int, k: int) -> range:
        return range(k * FAN, min((k + 1) * FAN, len(self.levels[level - 1])))

    def sizes_fit(self, level: int, p: int, q: int) -> bool:
        least, most = self.least[level], self.most[level]
        return most[p] * 100 >= PERCENT * least[q] and most[q] * 100 >= PERCENT * least[p]

    def may_overlap(self, level: int, p: int, q: int) -> bool:
        """Whether the largest possible overlap of two sets below the nodes is enough for the least needed one."""
        n, m = self.least[level][p], self.least[level][q]
        wanted = max(needed(n, m), -(-PERCENT * max(n, m) // 100))
        common = int(np.bitwise_count(self.masks[level][p] & self.masks[level][q]).sum())
        return common + min(self.spare[level][p], self.spare[level][q]) >= wanted


class Forest:
    """Union-find."""

    def __init__(self, size: int):
        self.up = np.arange(size)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = int(self.up[x])
        return x

    def flat(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _likeness(sets: list[np.ndarray]) -> np.ndarray:
    """An order in which sets with much in common lie together: by groups that least hashes tie, then by size.

    Sets with a similarity of s agree in one least hash with probability s, and almost surely in one of several.
    """
    size = np.array([len(s) for s in sets])
    flat, first = np.concatenate(sets), np.cumsum(size) - size
    groups = Forest(len(sets))
    for salt in LIKENESS:
        least = np.minimum.reduceat(mix(flat ^ U64(salt)), first)
        order = np.argsort(least, kind="stable")
        for k in np.flatnonzero(least[order][1:] == least[order][:-1]).tolist():
            groups.join(int(order[k]), int(order[k + 1]))
    return np.lexsort((size, groups.flat()))


def tree_join(sets: list[np.ndarray], side: np.ndarray | None = None, every: bool = False, tally: Counter | None = None) -> Iterator[tuple[int, int]]:
    """Links that span the components of the sets (indices), or every link; with sides, only links between different ones count.

    ``tally`` counts the node pairs met, and those left out by size and by overlap.
    """
    tally = Counter() if tally is None else tally
    order = _likeness(sets)
    sets = [sets[k] for k in order.tolist()]
    usual = int(np.quantile([len(s) for s in sets], 0.95))  # larger sets just have more excess
    bits = 1 << min(15, max(9, (8 * usual).bit_length()))
    tree, forest = SignatureTree(sets, bits), Forest(len(sets))
    sides = None if side is None else np.asarray(side)[order]
    todo = [(len(tree.levels) - 1, 0, 0)]
    while todo:
        level, p, q = todo.pop()
        (a, b), (c, d) = tree.levels[level][p], tree.levels[level][q]
        tally["met"] += 1
        if not tree.sizes_fit(level, p, q):
            tally["size"] += 1
            continue
        if p != q and not tree.may_overlap(level, p, q):
            tally["overlap"] += 1
            continue
        up = forest.flat()
        if not every and up[a] == up[c] and (up[a:b] == up[a]).all() and (up[c:d] == up[a]).all():
            continue
        if level:
            todo += [(level - 1, i, j) for i in tree.children(level, p) for j in tree.children(level, q) if p != q or i <= j]
            continue
        common = np.bitwise_count(tree.rows[a:b, None] & tree.rows[None, c:d]).sum(axis=2, dtype=np.int64)
        bound = common + np.minimum(tree.excess[a:b, None], tree.excess[None, c:d])
        n, m = tree.n[a:b, None], tree.n[None, c:d]
        ok = bound >= np.maximum(needed(n, m), -(-PERCENT * np.maximum(n, m) // 100))
        if not every:
            ok &= up[a:b, None] != up[None, c:d]
        if p == q:
            ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
        if sides is not None:
            ok &= sides[a:b, None] != sides[None, c:d]
        i, j = np.nonzero(ok)
        for x, y in zip((i + a).tolist(), (j + c).tolist(), strict=True):
            if not every and forest.find(x) == forest.find(y):
                continue
            s, t = sets[x], sets[y]
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both * 100 >= PERCENT * (len(s) + len(t) - both):
                if not every:
                    forest.join(x, y)
                yield int(order[x]), int(order[y])


def _cluster_links(every: bool):
    def run(table: pa.Table) -> pa.Table:
        sids: list[int] = []
        sets: list[np.ndarray] = []
        sides: list[int] = []
        wanted, block = table.column("sid").to_pylist(), table.column("block").to_pylist()
        across = bool(table.num_rows) and table.column("i")[0] != table.column("j")[0]
        have: set[int] = set()
        at = 0
        for _, _, w in word_blocks(table.column("text"), lower=True):
            for s in shingle_sets(w):
                if len(s) and wanted[at] == set_id(s) and wanted[at] not in have:
                    have.add(wanted[at])
                    sids.append(wanted[at])
                    sets.append(s)
                    sides.append(block[at])
                at += 1
        # for every link once, pairs within a block are left to the task that has only this block
        links = list(tree_join(sets, np.array(sides) if every and across else None, every)) if len(sets) > 1 else []
        return pa.table({"a": pa.array([sids[i] for i, _ in links], pa.int64()), "b": pa.array([sids[j] for _, j in links], pa.int64())})

    return run


def _linked(docs: DataFrame, id_col: str, text_col: str, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_hash, n, sid) of every row, (sid, doc_id, n) of every set, and the links (a, b) of sets: every one, or such that span the components."""
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    first = written(rows.mapInArrow(_first_pass, _SETS))
    sets = first.filter(F.col("n").isNotNull()).select("doc_id", "text_hash", "n", "sid")
    common = spark.sparkContext.broadcast(common_slots(first.filter(F.col("chunk").isNotNull()).select("chunk", "counts")))

    postings = rows.select("text").mapInArrow(_postings(common), "token long, sid long")
    tokens = postings.groupBy("token").agg(F.min("sid").alias("least"), F.max("sid").alias("most"), F.count(F.lit(1)).alias("rows")).filter("least < most")
    tokens = written(tokens.select("token", "least", (F.col("rows") > SMALL).alias("large"), "rows"))
    shared = written(spread_join(postings, tokens, ["token"], "rows"))
    release(spark)
    signed = settled(rows.select("text").mapInArrow(_signatures(common), "sid long, n long, sig binary").groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig")))
    star = shared.filter("large").groupBy("sid").agg(F.min("least").alias("star"))
    near = shared.filter("not large").join(signed.join(star, "sid", "left"), "sid").select("token", "sid", "n", "sig", "star").repartition("token").sortWithinPartitions("token", "sid")
    stars = shared.filter("large and sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b")).distinct()
    edges = settled(near.mapInArrow(_candidate_edges, "a long, b long, sure boolean"))
    doubtful = edges.filter("not sure").select("a", "b").distinct()
    known = shared.groupBy("sid").agg(F.collect_set("token").alias("tokens")).join(signed, "sid").select("sid", "tokens", "n", F.substring("sig", 1, 8).alias("end"))
    left = known.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"), F.col("end").alias("ea"))
    right = known.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"), F.col("end").alias("eb"))
    rest = lambda n: F.ceil(n * PERCENT / 100) - 1
    most = F.size(F.array_intersect("ta", "tb")) + F.when(F.col("ea") <= F.col("eb"), rest(F.col("na"))).otherwise(rest(F.col("nb")))
    counted = doubtful.join(left, "a").join(right, "b").filter(most >= F.ceil((F.col("na") + F.col("nb")) * PERCENT / (100 + PERCENT))).select("a", "b")
    labels = components(edges.filter("sure").select("a", "b").unionByName(stars).unionByName(counted))

    # a set is named by its least doc_id, and its text found by that and the text's hash
    named = F.coalesce("doc_id", F.lit(LAST_ID))
    of_set = sets.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", named).alias("text_hash"), F.first("n").alias("n"))
    members = settled(of_set.join(labels, F.col("sid") == F.col("node")).select("sid", named.alias("key"), "text_hash", "n", "label"))
    sizes = written(members.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("k"), F.count(F.lit(1)).alias("members")))
    placed = spread_join(members, sizes, ["label"], "members").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("k")))
    # block i meets every block j in task (least, greatest)
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select(
        "sid", "key", "text_hash", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    texts = rows.select(named.alias("key"), "text_hash", "text").join(members.select("key", "text_hash"), ["key", "text_hash"], "left_semi")
    texts = texts.groupBy("key", "text_hash").agg(F.first("text").alias("text"))
    links = dealt.join(texts, ["key", "text_hash"]).select("label", "i", "j", "block", "sid", "text").groupBy("label", "i", "j").applyInArrow(_cluster_links(every), "a long, b long")
    return sets, of_set, links


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link once, as (a, b) with a < b: the least doc_ids of two unlike sets. Rows of equal sets are linked too, but not listed."""
    _, of_set, links = _linked(docs, id_col, text_col, True)
    name = of_set.select("sid", "doc_id")
    one, two = name.select(F.col("sid").alias("a"), F.col("doc_id").alias("x")), name.select(F.col("sid").alias("b"), F.col("doc_id").alias("y"))
    return links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False, with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; on request also n_links, the number of other rows linked with it, and the text_hash that tells rows of one id apart."""
    own = ["doc_id", *["text_hash"] * with_hash]
    sets, of_set, links = _linked(docs, id_col, text_col, with_links)
    if with_links:
        links = written(links)
    joined = components(links)

    named = of_set.join(joined, F.col("sid") == F.col("node"), "left").select("sid", "doc_id", F.coalesce("label", "sid").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    rows = sets.filter("n > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("rows"))
    component = written(named.join(least, "label").join(rows, "sid").select("sid", "component_id", "rows"))
    linked = spread_join(sets.filter("n > 0"), component, ["sid"], "rows")
    blank = sets.filter("n = 0").select(*own, F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if not with_links:
        return linked.select(*own, F.col("n").alias("n_shingles"), "component_id").unionByName(blank)
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(rows.withColumnRenamed("sid", "b"), "b").groupBy(F.col("a").alias("sid")).agg(F.sum("rows").alias("others"))
    counts = rows.join(others, "sid", "left").select("sid", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return linked.join(counts, "sid").select(*own, F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(blank.withColumn("n_links", F.lit(0).cast("long")))
