"""Operators against brute force, and their defined cases: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from functools import lru_cache
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import lm_scoring, queries, sql
from strandline.llm.bpe import encoder
from strandline.llm.components import components
from strandline.llm.exact_dedup import CuckooIndex, exact_dedup
from strandline.llm.language_id import language_id
from strandline.llm.lm_scoring import lm_scores
from strandline.llm.mixing import mix_sources, n_words
from strandline.llm.ngram_join import ngram_components, ngram_links, tree_join
from strandline.llm.packing import BestFit, best_fit_pack
from strandline.llm.quality_classifier import quality_classifier
from strandline.llm.quality_rules import quality_rules
from strandline.llm.substring_dedup import substring_dedup
from strandline.llm.textbuf import split_words, text_buffers
from strandline.llm.token_counts import SCRUB, TokenTree, _scrubs, edited_trees, token_counts, token_trees
from tests.oracle import SMALL, assert_same, connection

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, sid long, kept string, size string, label string"


def words(text):
    return [w for w in re.split("[\\x20\\x09-\\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def odd(spark):
    """Small rows of all odd kinds, with columns whose names the operators use themselves."""
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "gamma,", "délta", "eta.", "x", "ζ", "#tag", "a|b"]
    base = [rng.choice(vocab) + str(rng.randint(0, 99)) for _ in range(220)]
    texts = [None, "", " \n\t ", "one", "One", "ONE", "two words", "!!!", "12 34"]
    texts += [" ".join(base), " ".join(base).upper(), " ".join(base), " ".join(base[:200]), " ".join(["pre"] * 7 + base[30:120] + ["post"] * 9)]
    near = list(base)
    near[50] = "changed"
    texts += [" ".join(near), " ".join(base[:60]), "\n".join(["A line of words here."] * 12), " ".join(["run"] * 3000), "z" * 5000, "Home | About | Contact | Terms | Login | Help"]
    texts += [" ".join(f"Long{k % 37_000}." for k in range(45_000))]  # longer than any block of bytes that the operators work on
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", None, "c"]), 0, "w", -1, "k", "s", "l") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, " ".join(base), "en", "a", 0, "w", -1, "k", "s", "l"), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark):
    return spark.createDataFrame([(9, 1, 0), (14, 0, 0), (3, 1, 1), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_counts_of_words(spark, odd):
    for r in odd.select("text", n_words(odd.text).alias("n")).collect():
        assert r.n == len(words(r.text))


def test_quality_rules(spark, odd, none):
    got = quality_rules(odd).collect()
    assert len(got) == odd.count() and quality_rules(none).count() == 0
    want = []
    for x in odd.collect():
        w = words(x.text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [line for line in (x.text or "").split("\n") if words(line)]
        want.append((x.doc_id, len(w), sum(map(len, w)), sum((x.text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == sorted(want, key=repr)
    assert not any(r.kept and r.base_failed for r in got)
    shown = quality_rules(odd, carry=odd.columns, with_text=True).collect()
    assert sorted((tuple(r)[: len(odd.columns)] for r in shown), key=repr) == sorted(map(tuple, odd.collect()), key=repr)
    assert quality_rules(odd, carry=odd.columns).filter("verdict_kept").columns[: len(odd.columns)] == odd.columns
    assert quality_rules(odd, with_text=True).filter("doc_id = 19").first().cleaned_text == ""


def test_exact_dedup(spark, odd, none):
    got = exact_dedup(odd).collect()
    assert len(got) == odd.count() and exact_dedup(none).count() == 0
    rows = odd.collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(LOW), []).append(r.doc_id)
    want = sorted(((r.doc_id, max((d for d in groups[(r.text or "").translate(LOW)] if d is not None), default=None), len(groups[(r.text or "").translate(LOW)]), hashlib.sha256((r.text or "").translate(LOW).encode()).hexdigest()) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want


def test_cuckoo_index():
    rng, index, live = random.Random(1), CuckooIndex(2), {}
    for k in range(20_000):
        d = hashlib.sha256(str(rng.randint(0, 3000)).encode()).digest()
        if d in live and rng.random() < 0.4:
            assert index.delete(d) and not index.delete(d)
            del live[d]
        elif d not in live:
            index.insert(d, k)
            live[d] = k
        entry = index.find(d)
        assert (entry[1] if entry else None) == live.get(d)
    assert index.live == len(live) and index.resizes > 0 and {e[0] for e in index.entries()} == set(live)
    clash = CuckooIndex(2)
    same = [bytes(10) + bytes([i]) + bytes(21) for i in range(8)]
    for s in same:
        clash.insert(s, s)
    assert all(clash.find(s)[1] == s for s in same) and clash.find(bytes(10) + bytes([99]) + bytes(21)) is None


def shingles(text):
    w = words((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_components(texts):
    """(set size, least id) of every (id, text), ids null or not."""
    sets = [shingles(t) for _, t in texts]
    low = list(range(len(texts)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return sorted(((d, len(sets[i]), ids.get(find(i))) for i, (d, _) in enumerate(texts)), key=repr)


def test_ngram_components(spark, odd, none):
    assert ngram_components(none).count() == 0
    rng = random.Random(8)
    base = [f"q{k}" for k in range(120)]
    near = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in (5, 60, 100)]
    far = " ".join(rng.sample(base, 120))
    more = [(500, " ".join(base)), (None, near[0]), (None, near[0]), (None, near[1]), (501, near[2]), (501, far), (502, far), (None, far + " x"), (None, "only null ids here and nowhere else"), (None, "only null ids here and nowhere else")]
    # a and b are alike only through a text that has no id
    chain = [base[:100], ["c0", "c1", "c2"] + base[3:100], ["c0", "c1", "c2"] + base[3:97] + ["d0", "d1", "d2"]]
    more += [(600, " ".join(chain[0]) + " z"), (None, " ".join(chain[1]) + " z"), (601, " ".join(chain[2]) + " z")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    want = jaccard_components([tuple(r) for r in docs.collect()])
    for with_links in (False, True):
        got = ngram_components(docs, with_links=with_links).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want


def test_large_groups_of_a_token_stay_whole(spark, monkeypatch):
    monkeypatch.setattr("strandline.llm.ngram_join.SMALL", 4)
    rng = random.Random(3)
    base = [f"g{k}" for k in range(60)]
    texts = [" ".join(base[:k] + [f"n{k}{i}"] + base[k + 1 :]) for i in range(3) for k in rng.sample(range(60), 8)]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == jaccard_components(rows)


def test_signature_tree_prunes():
    rng = np.random.default_rng(11)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        for _ in range(50):
            cut = base[rng.random(200) > 0.04]
            sets.append(np.unique(np.concatenate([cut, rng.integers(0, 1 << 63, 6).astype(np.uint64)])))
    order = rng.permutation(len(sets))
    tally = Counter()
    links = set(map(frozenset, tree_join([sets[k] for k in order], every=True, tally=tally)))
    group = order // 50
    assert all(len({group[x] for x in link}) == 1 for link in links)
    # all but the pairs of leaves that share a group are left out, most of them by overlap
    assert tally["overlap"] + tally["size"] > 0.7 * tally["met"] and tally["overlap"] > tally["size"]
    for g in range(0, 40, 13):
        mine = np.flatnonzero(group == g)
        want = set()
        for i in mine.tolist():
            for j in mine.tolist():
                x, y = sets[order[i]], sets[order[j]]
                both = len(np.intersect1d(x, y))
                if i < j and both * 100 >= 80 * (len(x) + len(y) - both):
                    want.add(frozenset((i, j)))
        assert {link for link in links if min(link) in set(mine.tolist())} == want


def test_tree_join_is_exact():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)
        for _ in range(rng.integers(1, 6)):
            cut = base[rng.random(len(base)) > rng.random() * 0.25]
            if len(cut):
                sets.append(np.unique(np.concatenate([cut, rng.integers(0, 1 << 63, rng.integers(0, 1 + len(base) // 8)).astype(np.uint64)])))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    want = [find(i) for i in range(len(sets))]
    up = list(range(len(sets)))
    for a, b in tree_join(sets):
        up[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(i) for i in range(len(sets))] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100}


def cut_windows(rows):
    """(id, words, words removed, kept words) of every (id, text): a null id is larger than all others and equal to itself."""
    rank = lambda d: float("inf") if d is None else d
    first: dict = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, rank(d)), rank(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = {i + k for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < rank(d) for k in range(50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark, odd, none):
    assert substring_dedup(none).count() == 0
    columns = ("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256")
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(70))
    many = [(k if k % 7 else None, " ".join(rng.choice("uvwxyz") + str(rng.randrange(50)) for _ in range(rng.randrange(40))) + " " + passage + f" tail{k} " + rng.choice([a, b, c, ""])) for k in range(60)]
    repeated = [(1, a), (None, a), (None, b), (7, a), (7, c), (7, c), (None, None), (None, b)]
    for docs in (odd.select("doc_id", "text"), spark.createDataFrame(repeated, "doc_id long, text string"), spark.createDataFrame(many + repeated, "doc_id long, text string").repartition(3)):
        got = sorted((tuple(r[x] for x in columns) for r in substring_dedup(docs, with_text=True).collect()), key=repr)
        assert got == cut_windows([(r.doc_id, r.text) for r in docs.collect()])


def test_substring_dedup_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("strandline.llm.cluster.HOT_KEYS", 20)
    rng = random.Random(7)
    passage, line = " ".join(f"p{k}" for k in range(90)), "the same line again and again of ten words "
    rows = [(k, f"s{k} " * rng.randrange(3) + passage + f" t{k}" * rng.randrange(3) + " " + line * (12 if k % 3 == 0 else 0)) for k in range(45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256) for r in substring_dedup(docs, with_text=True).collect()), key=repr)
    assert got == cut_windows(rows)


def test_mixing(spark, odd, none):
    assert mix_sources(none).count() == 0
    got = mix_sources(odd).collect()
    assert len(got) == odd.count()
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + pow(id % 37, 2) AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('s', id % 4) END AS source")
    out, again = (sorted(map(tuple, mix_sources(many.repartition(k)).collect())) for k in (2, 7))
    assert out == again
    taken, target, size = Counter(), {}, {}
    source = {r.doc_id: r.source for r in many.collect()}
    for d, _, s, t, k, _ in out:
        taken[source[d]] += k
        target[source[d]], size[source[d]] = t, s
    order = sorted(x for x in size if x is not None) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    open_, left, want = set(order), sum(size.values()), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * size[s]}
        if not full:
            want |= share
            break
        for s in full:
            want[s] = 3 * size[s]
            left -= want[s]
        open_ -= full
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= max(40, 0.003 * target[s])


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("n", [1, 2, 40, 64, 65, 700])
def test_mixing_pivots_sources_of_any_size(spark, n):
    rows = spark.range(n).selectExpr("id AS doc_id", "repeat('w ', cast(5 + pow(id % 13, 2) AS int)) AS text", "'a' AS source")
    rows = rows.unionByName(spark.range(400).selectExpr("id + 10000 AS doc_id", "repeat('w ', 30) AS text", "'b' AS source")).unionByName(spark.range(300).selectExpr("id + 20000 AS doc_id", "repeat('w ', 20) AS text", "'c' AS source")).cache()
    taken, rate, runs = Counter(), {}, 6 if n > 64 else 12
    for seed in range(runs):
        got = mix_sources(rows, with_key=True, seed=seed).collect()
        for s in "abc":
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) + 1e-6
        for r in got:
            if r.source == "a":
                assert r.copies - r.target / r.source_size < 1 and r.target / r.source_size - r.copies < 1
                taken[r.doc_id] += r.copies
                rate[r.doc_id] = r.target / r.source_size
    assert abs(sum(taken.values()) / runs - sum(rate.values())) <= 4 * (sum((x % 1) * (1 - x % 1) for x in rate.values()) / runs) ** 0.5 + 0.1


def test_mixing_of_rows_without_ids(spark):
    rows = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN id END AS doc_id", "concat(repeat('w ', cast(id % 4 AS int)), CASE WHEN id < 450 THEN 'same' ELSE concat('t', id) END) AS text", "concat('s', id % 2) AS source")
    out, again = (sorted(map(tuple, mix_sources(rows.repartition(k)).collect()), key=repr) for k in (2, 5))
    assert out == again and len(out) == 900
    for s in ("s0", "s1"):
        mine = [r for r in mix_sources(rows, with_key=True).collect() if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_public_tokenizer():
    rng = random.Random(9)
    letters = list("ab s'tmdrevl  \n\t\ré  　 1²٣!?.\U0001f600中'\x1c\x85_") + ["'s", "'re", "<|endoftext|>", "<|", "  <|endoftext|>"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    buf, off = text_buffers(pa.array(texts))
    ids, place, _, first = encoder(queries.TOKENIZER).tokens(buf, off)
    at = place[first]
    assert all(ids[at[i] : at[i + 1]].tolist() == ids_of(t) for i, t in enumerate(texts))


def test_packing(spark, odd, none):
    assert best_fit_pack(none, queries.TOKENIZER).count() == 0
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(300, "a <|endoftext|> b<|endoftext|><|endoftext|>"), (301, "z" * 300_000 + " end")], "doc_id long, text string"))
    got = best_fit_pack(docs, queries.TOKENIZER, limit=100).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*ids_of(r.text), 2]
        first = len(ids) % 100 or 100
        cuts = [0, *range(first, len(ids) + 1, 100)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    of_bin: dict = {}
    for r in got:
        of_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in of_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100


def best_fit(lengths, limit, most):
    """Bins of pieces one after another: the fullest open one that takes the piece; the fullest closes when there is no room to open one."""
    free, out, made = {}, [], 0
    for n in lengths:
        fits = [(f, -b) for b, f in free.items() if f >= n]
        if fits:
            at = min(f for f, _ in fits)
        else:
            if len(free) >= most:
                full = min(free.values())
                del free[max(b for b, f in free.items() if f == full)]
            at, free[made] = limit, limit
            made += 1
        out.append(limit - at)
        b = max(b for b, f in free.items() if f == at)
        free[b] -= n
        if not free[b]:
            del free[b]
    return out, made


def test_best_fit_with_more_bins_than_may_be_open():
    rng = random.Random(5)
    for most in (1, 3, 20):
        lengths = [rng.choice([rng.randint(1, 100), 100, 51, 7]) for _ in range(2000)]
        b = BestFit(100, most)
        places = [b.place(n) for n in lengths]
        offsets, made = best_fit(lengths, 100, most)
        assert ([o for _, o in places], b.made) == (offsets, made) and b.open <= most
    b, lengths = BestFit(100, 20), [rng.randint(1, 100) for _ in range(5000)]
    for n in lengths:
        b.place(n)
    assert b.made < 1.1 * sum(lengths) / 100


def test_best_fit_closes_the_fullest():
    b = BestFit(10, 2)
    assert [b.place(n) for n in (7, 6, 3, 8, 4)] == [(0, 0), (1, 0), (0, 7), (2, 0), (1, 6)]
    with pytest.raises(ValueError):
        b.place(11)


def pieces_of(bpe, text):
    b = np.frombuffer(text, dtype=np.uint8)
    ids, place, start, _ = bpe.tokens(b, np.array([0, len(b)]))
    return np.diff(np.append(start, len(b))).tolist() if len(start) else [], np.diff(place).tolist() if len(start) else []


def test_token_tree():
    rng, bpe = random.Random(2), encoder(queries.TOKENIZER)
    for _ in range(200):
        text = "".join(rng.choice([*"ab s'tre  \n1!é中", "<|endoftext|>", "<|endof"]) for _ in range(rng.choice([0, 5, 300, 2000]))).encode()
        tree = TokenTree(text, *pieces_of(bpe, text), bpe)
        assert tree.total == len(ids_of(text.decode()))
        for _ in range(6):
            u = tree.text.decode()
            a = rng.randint(0, len(u))
            b = rng.randint(a, min(len(u), a + rng.choice([0, 9, 400])))
            tree.edit(len(u[:a].encode()), len(u[:b].encode()), "".join(rng.choice([*"ab 's1\n", "text|>", "<|end"]) for _ in range(rng.choice([0, 2, 60, 900]))).encode())
            now = tree.text
            assert (tree.sizes(), tree.counts()) == pieces_of(bpe, now) and tree.total == len(ids_of(now.decode())) and tree.pieces == len(tree.sizes())
            assert tree.root.bytes == len(now)


def test_many_edits_of_one_text_touch_little():
    rng, bpe = random.Random(6), encoder(queries.TOKENIZER)
    text = bytearray(" ".join(f"word{k % 977} and" for k in range(60_000)).encode())
    tree = TokenTree(bytes(text), *pieces_of(bpe, bytes(text)), bpe)
    for _ in range(10_000):
        a = rng.randrange(len(text) - 8)
        new = rng.choice([b"", b"x", b" new words ", b"12"])
        text[a : a + 3] = new
        tree.edit(a, a + 3, new)
    assert tree.text == bytes(text) and (tree.sizes(), tree.counts()) == pieces_of(bpe, bytes(text))
    assert tree.reencoded < 10_000 * 60 and tree.touched < 10_000 * 12


def test_token_counts(spark, odd, none):
    assert token_counts(none, queries.TOKENIZER).count() == 0
    docs = spark.createDataFrame([(100, "mail a.b@c.org or 10.20.30.40, id 123456789!"), (101, "clean"), (100, "no number, <|endoftext|> 1234567"), (None, "12345678 x"), (None, "12345678 x"), (None, "y 12345678")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(docs)
    want = []
    for r in docs.collect():
        after = SCRUB.sub(b"[removed]", (r.text or "").encode())
        want.append((r.doc_id, len(ids_of(r.text)), len(SCRUB.findall((r.text or "").encode())), len(ids_of(after.decode()))))
    got = token_counts(docs, queries.TOKENIZER).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in got), key=repr) == sorted(want, key=repr)


def test_scrubs_take_little_memory():
    """A batch is searched a block at a time, and its edits are kept as numbers (it took 17 and 40 times the text)."""
    plain = ["Call 5 of 17 at 10.20.30.40, " + "then some more words, and the year 1999. " * 100] * 4000
    dense = ["1234567 " * 250_000]
    for texts, most in ((plain, 1.5), (dense, 16)):
        text = pa.array(texts)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)))] * 2 + [text], ["key", "text_hash", "text"])
        tracemalloc.start()
        held = tracemalloc.get_traced_memory()[0]
        n = sum(len(e) for b in _scrubs(iter([batch])) for e in b.column("edits"))
        peak = tracemalloc.get_traced_memory()[1] - held
        tracemalloc.stop()
        assert n == sum(len(SCRUB.findall(t.encode())) for t in texts) and peak < most * text.nbytes


def test_scrubs_of_several_blocks():
    texts = [None, "", "x 1234567", *["words " * 40_000, "", "a@b.org 1.2.3.4"] * 30, "9" * (5 << 20), None, "12345678", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 100 + len(texts)))] * 2 + [pa.array(texts)], ["key", "text_hash", "text"])
    got = [r for part in (batch, batch.slice(3, 8), batch.slice(0, 0)) for b in _scrubs(iter([part])) for r in b.to_pylist()]
    want = []
    for k in [*range(len(texts)), *range(3, 11)]:
        edits = [{"begin": m.start(), "end": m.end(), "new": b"[removed]"} for m in SCRUB.finditer((texts[k] or "").encode())]
        want += [{"key": 100 + k, "text_hash": 100 + k, "text": texts[k], "edits": edits}] if edits else []
    assert got == want


def test_kept_trees_take_edits(spark):
    rows = [(k, " ".join(f"w{k + i}" for i in range(3000))) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trees = token_trees(docs, queries.TOKENIZER)
    edits = [(k, t, [{"begin": 10, "end": 14, "new": bytearray(b" more text ")}, {"begin": 5000, "end": 5000, "new": bytearray(b"9")}]) for k, t in rows]
    edits = spark.createDataFrame(edits, "key long, text string, edits array<struct<begin:long,end:long,new:binary>>").withColumn("text_hash", F.xxhash64("text")).select("key", "text_hash", "text", "edits")
    for r in edited_trees(trees, edits, queries.TOKENIZER).collect():
        t = dict(rows)[r.key]
        new = t[:10] + " more text " + t[14:5000] + "9" + t[5000:]
        assert (r.text, r.n_tokens_edited) == (new, len(ids_of(new))) and r.n_reencoded < 60


def test_language_id(spark, none, odd):
    assert language_id(none).count() == 0 and language_id(odd).count() == odd.count()
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").collect()
    want = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.97 * len(held)
    blank = language_id(spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (3, "hello there", "en")], "doc_id long, text string, lang string"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in blank.filter("doc_id < 3").collect()} == {1: ("und", 0.0), 2: ("und", 0.0)}


def test_quality_classifier(spark, odd, none):
    assert quality_classifier(none, labels_of(spark)).count() == 0
    assert quality_classifier(odd, labels_of(spark)).count() == odd.count()
    assert quality_classifier(odd, labels_of(spark).limit(0)).count() == odd.count()
    rng = random.Random(6)
    plain = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(900):
        kind = i % 3
        text = [rng.choice(plain) for _ in range(60)] + (["vile", "nasty"] if kind == 0 else [])
        rows.append((i, " ".join(t + "$$$" if kind == 1 else t for t in text), int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier(docs.select("doc_id", "text"), docs.filter("doc_id < 600").select("doc_id", "quality", "toxic")).collect()}
    fresh = [got[i] for i in range(600, 900)]
    assert sum(r.kept == (r.doc_id % 3 == 2) for r in fresh) >= 285
    assert all(r.p_good <= r.p_not_toxic for r in fresh)


def test_quality_classifier_selects_good_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = (F.crc32(F.col("doc_id").cast("string")) % 5) == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in quality_classifier(docs, labels.filter(~held)).join(labels.filter(held).select("doc_id"), "doc_id", "left_semi").collect()}
    fresh = [(r.quality and not r.toxic, bool(r.toxic), got[r.doc_id]) for r in labels.filter(held).collect()]
    good, other = [r.p_good for g, _, r in fresh if g], [r.p_good for g, _, r in fresh if not g]
    assert sum((x > y) + (x == y) / 2 for x in good for y in other) > 0.95 * len(good) * len(other)
    assert sum(r.kept for g, _, r in fresh if g) >= 0.9 * len(good)
    assert sum(not r.kept for g, _, r in fresh if not g) >= 0.9 * len(other)
    assert sum(not r.kept for _, t, r in fresh if t) >= 0.9 * sum(t for _, t, _ in fresh)


def test_lm_scores(spark, odd, none):
    assert lm_scores(none).count() == 0
    rows = odd.collect()
    train = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 != 0 for r in rows]
    tokens = [[*words((r.text or "").translate(LOW)), "\n"] for r in rows]
    counts = Counter()
    for t, x in zip(tokens, train, strict=True):
        if x:
            counts.update(t)
    total, kinds = sum(counts.values()), len(counts)
    want = [(r.doc_id, not x, len(t), sum(counts[y] > 0 for y in t), total, round(sum(log10((counts[y] + 0.1) / (total + 0.1 * (kinds + 1))) for y in t), 6)) for r, t, x in zip(rows, tokens, train, strict=True)]
    got = lm_scores(odd.repartition(3)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_lm_probabilities_are_a_distribution():
    """All next words of a small alphabet, the unseen word's share among them, add up to one."""
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(30)]
    texts = [" ".join(rng.choice(vocab[: 5 + 25 * (k % 2)]) for _ in range(40)) for k in range(50)]

    def read(texts):
        buf, off = text_buffers(pa.array(texts))
        w = split_words(buf, off)
        return w, lm_scoring.tokens_of(w)

    w, t = read(texts)
    counts = Counter(t.mark.tolist())
    of_class, fresh = np.zeros(lm_scoring.CLASSES, dtype=np.int64), np.zeros(lm_scoring.CLASSES, dtype=np.int64)
    for m, n in counts.items():
        of_class[m >> 52] += n
        fresh[m >> 52] += n == 1
    tables, model = lm_scoring.Tables.empty(lm_scoring.table_bits(len(counts), sum(counts.values())), of_class, fresh), lm_scoring.MixingModel()
    code = t.code
    for (_, bit, _), cells in zip(lm_scoring.bits_of(code), lm_scoring.cells_of(t, code, tables.bits), strict=True):
        for x in cells:
            np.add.at(tables.cells, x, 1 + (bit << 32))
    for _ in range(3):
        model.learn(tables, t, model.no_sums())
    # without a match, the classes' bits make a distribution, and so do the words in a class with the share of new ones
    for context in ("v1 v2", "v29 v3", "unheard of"):
        total = 0.0
        for c in range(lm_scoring.CLASSES):
            one, tok = read([context])
            tok.mark[-1] = np.uint64(c << 52)
            count = np.array([counts.get(m, 0) for m in tok.mark.tolist()])
            bits = model.cost(tables, one, tok, np.zeros(len(tok.mark), dtype=bool), count)[-1]
            total += 2 ** (-bits) * (of_class[c] + max(1, fresh[c])) / max(1, fresh[c])
        assert abs(total - 1) < 1e-3


def test_lm_match_votes():
    m = lm_scoring.Matches(8)
    m.learn(np.array([1, 1, 1, 2, 2, 3]), np.array([7, 7, 9, 5, 6, 4], dtype=np.uint32))
    assert (m.word[1], m.votes[1], m.votes[2], m.word[3], m.votes[3]) == (7, 1, 0, 4, 1)
    m.vote(np.array([1, 3]), np.array([9, 4], dtype=np.uint32), np.array([3, 300]))
    assert (m.word[1], m.votes[1], m.votes[3]) == (9, 2, 255)


def test_lm_scores_beat_the_base_and_tell_copies_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = lm_scores(docs).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # copies of a training text are told apart from the others, whether it is one of them or not
    n = Counter(r.text for r in docs.collect() if len(words(r.text)) >= 30 and zlib.crc32(str(r.doc_id).encode()) % 10)
    bits = {r.doc_id: r for r in got}
    usual = sorted(r.bits_per_byte for r in got)[len(got) // 2]
    copies = [bits[r.doc_id] for r in docs.collect() if n[r.text] > (not bits[r.doc_id].held_out)]
    assert len(copies) > 20 and sum(r.bits_per_byte < 0.5 * usual for r in copies) > 0.9 * len(copies)


def test_lm_scores_know_the_order_of_words(spark):
    rng = random.Random(9)
    follows = {f"w{k}": f"w{(k * 7 + 3) % 40}" for k in range(40)}

    def text():
        out = [f"w{rng.randrange(40)}"]
        while len(out) < 30:
            out.append(follows[out[-1]])
        return " ".join(out)

    rows = [(k, text()) for k in range(400)]
    rows += [(k + 1000, " ".join(rng.sample(t.split(), 30))) for k, t in rows if zlib.crc32(str(k + 1000).encode()) % 10 == 0 and zlib.crc32(str(k).encode()) % 10]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    shuffled = [k for k, _ in rows if k >= 1000]
    assert shuffled and all(got[k].held_out and got[k].score < 2 * got[k - 1000].score for k in shuffled)
    whole = [got[k] for k, _ in rows if k < 1000 and got[k].held_out]
    assert sum(r.score for r in whole) > sum(r.base_score for r in whole)


def test_lm_tables_grow_with_the_vocabulary():
    cells = [sum(1 << b for b in lm_scoring.table_bits(1 << k, 8 << k)) for k in (12, 14, 16)]
    assert all(b > 3 * a for a, b in zip(cells, cells[1:], strict=False))


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), connection(), sql.ORACLES[name])


ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, mix_key long, cleaned_text string, verdict_kept int, gone_id long"


@pytest.fixture(scope="module")
def corpus():
    """Rows of documents, with clashing columns, of all kinds that the stages have to tell apart."""
    rng = random.Random(12)
    vocab = [f"{a}{b}" for a in ("river", "stone", "garden", "letter", "winter") for b in range(60)]

    def prose(n):
        return "\n".join(" ".join(rng.choice(vocab) for _ in range(20)) + "." for _ in range(n))

    base = [prose(rng.randint(2, 12)) for _ in range(40)]
    menu = "Home | About | Contact | Terms | Login | Help"
    texts = [*base, base[0], base[0].upper(), base[1], base[2].replace("river", "River"), menu, None, "", "too short.", base[3] + "\n" + menu, "\n".join([menu] * 9 + [base[4]]), "word " * 400]
    for k in (5, 6, 7):
        w = base[k].split(" ")
        w[3] = "changed"
        texts += [" ".join(w), " ".join(w) + "."]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, base[8]), (None, prose(3)), (None, base[9] + " tail."), (3, prose(2)), (3, base[10]), (4, base[4]), (None, prose(4))]
    rng.shuffle(rows)
    return [(d, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), rng.choice([None, 7]), "r", 1, "c", 0, 2) for d, t in rows]


def line_fails(line):
    n = line.count(" ") + 1
    phrases = "all rights reserved|cookie policy|privacy policy|terms of service|click here|subscribe to our newsletter|sign up|log in to|javascript is disabled|enable cookies"
    unended = not re.search("[.!?:;\"')\\]\u2026\u201d\u00bb][\x20\x09-\x0D]*$", line) and n > 8
    shares = (line.count("|") * 100 > n * 30, line.count("!!") * 100 > n * 30, len(re.findall("[#*$%&<>]", line)) * 100 > n * 30, len(re.findall(phrases, line.lower())) * 100 > n * 2)
    return bool(line.strip(" ")) and (unended or any(shares))


def good_lines(text):
    """The text without failing lines, or None if the document goes."""
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    solid = [x for x in (text or "").split("\n") if words(x)]
    lost = sum(len(x) for x in solid if line_fails(x))
    if len(w) < 10 or 100 * len(hit) > 20 * len(w) or lost * 100 > 30 * sum(map(len, solid)):
        return None
    return "\n".join(x for x in text.split("\n") if not line_fails(x))


def kept_of_copies(rows):
    high: dict = {}
    for r in rows:
        k = (r[1] or "").translate(LOW)
        high[k] = max((d for d in (r[0], high.get(k)) if d is not None), default=None)
    return [r for r in rows if r[0] == high[(r[1] or "").translate(LOW)]]


def kept_of_near_copies(rows):
    sets, low = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                low[max(find(i), find(j))] = min(find(i), find(j))
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [r for i, r in enumerate(rows) if least.get(find(i)) == r[0] or least.get(find(i)) is None]


def test_pipeline_equals_plain_python(spark, corpus):
    import corpus_pipeline

    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.createDataFrame(corpus, ODD_COLUMNS).repartition(3)
    same = lambda df, rows: sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)
    docs, rows = stages[0](spark, docs, SMALL), [(r[0], good_lines(r[1]), *r[2:4], len(good_lines(r[1])), *r[5:]) for r in corpus if good_lines(r[1]) is not None]
    assert same(docs, rows) and len(rows) < len(corpus)
    docs, rows = stages[1](spark, docs, SMALL), kept_of_copies(rows)
    assert same(docs, rows)
    docs, rows = stages[2](spark, docs, SMALL), kept_of_near_copies(rows)
    assert same(docs, rows) and any(r[0] is None for r in rows)
    mixed = stages[3](spark, docs, SMALL)
    times, alike = Counter(map(tuple, mixed.collect())), Counter(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    weight = {s: k + 1 for k, s in enumerate([*sorted(x for x in sizes if x is not None), None])}
    for s, size in sizes.items():
        target = sum(sizes.values()) * weight[s] / sum(weight.values())  # far below three times the size here
        assert target < 3 * size
        mine = [(r, n) for r, n in alike.items() if r[3] == s]
        assert all(n * int(target / size) <= times[r] <= n * (int(target / size) + 1) for r, n in mine)
        assert abs(sum(times[r] * len(words(r[1])) for r, _ in mine) - target) <= max(len(words(r[1])) for r, _ in mine)
    assert set(times) <= set(rows) and mixed.columns == docs.columns
    want = Counter()
    for r, n in times.items():
        ids = [*ids_of(r[1]), 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += n
    packed = stages[4](spark, mixed, SMALL).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    room = Counter()
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 1024


def test_pipeline_of_empty_tables_and_whole_run(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], ODD_COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns and stage(spark, docs, SMALL).count() == 0
    assert corpus_pipeline.pack(spark, docs, SMALL).count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() > 100


@pytest.mark.parametrize("most", [1_500_000, 300])
def test_ngram_links_are_all_found(spark, monkeypatch, most):
    monkeypatch.setattr("strandline.llm.ngram_join.BLOCK_SHINGLES", most)
    rng = random.Random(5)
    base = [f"v{k}" for k in range(90)]
    texts = []
    for _ in range(25):
        near = list(base)
        near[rng.randrange(90)] = f"x{rng.randrange(999)}"
        texts.append(" ".join(near))
    texts += texts[:4] + ["", None, "alone in here", " ".join(base[30:])]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else []) for d, w in ((d, words(t)) for d, t in rows)}
    like = {(a, b) for a in sets for b in sets if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    first = {}
    for d, s in sets.items():
        first.setdefault(s, d)
    got = [tuple(r) for r in ngram_links(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in like if a < b and sets[a] != sets[b] and first[sets[a]] == a and first[sets[b]] == b}
    n = Counter(a for a, _ in like)
    plain = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    counted = ngram_components(docs, with_links=True).collect()
    assert {r.doc_id: r.n_links for r in counted} == {d: n[d] for d in sets} and {r.doc_id: (r.n_shingles, r.component_id) for r in counted} == plain
    assert len(got) > 25
