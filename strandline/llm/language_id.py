"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are its byte n-grams within words, hashed to buckets; their
embeddings are averaged and a linear softmax names the language. It is trained
by stochastic gradient descent in numpy on a bounded sample of the labelled rows
(``SAMPLE_ROWS``, spread over the languages by hash; with more languages than that,
those with the most rows), whose whole texts executors turn into counts of buckets.
A part of the sample is kept from
training to fit the softmax temperature and the score under which a prediction
is rejected. As averaging and the linear layer commute, prediction needs one
table of buckets x languages, whose size doesn't depend on the data; it is
broadcast, and whole texts are scored in one pass without a shuffle.

Defined cases: null text, or one without a letter, is `und` with score 0; without
any labelled row all texts are; other columns are ignored; each row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.cluster import only
from strandline.llm.hashed_text import subwords
from strandline.llm.textbuf import blocks, text_buffers

BUCKETS = 1 << 15
WIDTH = 16
EPOCHS = 4
RATE = 0.5
SAMPLE_ROWS = 6_000
CALIBRATION_PERCENT = 20
#: Accepted predictions of the calibration part are wrong at most this often.
ACCEPTED_ERROR = 0.01
BLOCK_BYTES = 1 << 18
UNKNOWN = "und"


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        bags = subwords(buf, off, len(self.table))
        raw = bags.sums(self.table) / np.maximum(bags.counts, 1)[:, None] + self.bias
        return _softmax(raw / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> LanguageModel:
    """SGD on the larger part of the sample's bags (buckets and their counts), calibration on the rest."""
    languages = sorted(set(labels))
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in labels], dtype=np.int64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    apart = order[: len(bags) * CALIBRATION_PERCENT // 100]
    fit = order[len(apart) :]
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    w, b = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    steps = max(1, EPOCHS * len(fit))
    done = 0
    for _ in range(EPOCHS):
        for d in rng.permutation(fit).tolist():
            index, n = bags[d]
            rate = RATE * (1 - done / steps)
            done += 1
            if not len(index):
                continue
            share = (n / n.sum())[:, None]
            hidden = (e[index] * share).sum(axis=0)
            z = hidden @ w + b
            z = np.exp(z - z.max())
            grad = z / z.sum()
            grad[y[d]] -= 1
            back = w @ grad
            w -= rate * np.outer(hidden, grad)
            b -= rate * grad
            e[index] -= rate * len(index) * share * back / np.sqrt(len(index))
    table = (e @ w).astype(np.float32)
    model = LanguageModel(languages, table, b, 1.0, 0.0)
    if len(apart):
        raw = np.stack([(table[i] * (n / max(1, n.sum()))[:, None]).sum(axis=0) if len(i) else np.zeros(len(languages)) for i, n in (bags[d] for d in apart)]) + b
        def loss(t: float) -> float:
            return float(-np.log(_softmax(raw / t)[np.arange(len(apart)), y[apart]] + 1e-12).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 121)), key=loss)
        p = _softmax(raw / model.temperature)
        top, right = p.max(axis=1), p.argmax(axis=1) == y[apart]
        rank = np.argsort(-top)
        wrong = np.cumsum(~right[rank]) / np.arange(1, len(rank) + 1)
        fine = np.flatnonzero(wrong <= ACCEPTED_ERROR)
        model.threshold = float(top[rank[fine[-1]]]) if len(fine) else 1.0
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts as buckets with their counts."""
    for batch in batches:
        buf, off = text_buffers(batch.column("text"))
        index, n = [], []
        for i, j in blocks(off, BLOCK_BYTES):
            bags = subwords(buf[off[i] : off[j]], off[i : j + 1] - off[i], BUCKETS)
            for a, b in zip(bags.first.tolist(), bags.first[1:].tolist(), strict=False):
                x, c = np.unique(bags.index[a:b], return_counts=True)
                index.append(x.astype("<u2").tobytes())
                n.append(c.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("lang"), pa.array(index, pa.binary()), pa.array(n, pa.binary())], ["place", "lang", "index", "n"])


def _sample(rows: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Bags of about ``SAMPLE_ROWS`` labelled texts, the same number a language where there are enough, chosen by hash."""
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang")).orderBy(F.desc("of_lang"), "lang").limit(SAMPLE_ROWS)
    found = counts.collect()
    if not found:
        return [], []
    each = max(1, SAMPLE_ROWS // len(found))
    few = rows.sparkSession.createDataFrame([tuple(r) for r in found], "lang string, of_lang long")
    place = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.join(F.broadcast(few), "lang").withColumn("place", place).filter(F.col("place") * F.col("of_lang") < each)
    bags = chosen.select("place", "lang", "text").mapInArrow(_bags, "place double, lang string, index binary, n binary")
    got = bags.orderBy("place", "lang", "index", "n").limit(2 * SAMPLE_ROWS).collect()
    return [(np.frombuffer(bytes(r[2]), dtype="<u2").astype(np.int64), np.frombuffer(bytes(r[3]), dtype="<u4").astype(np.int64)) for r in got], [r[1] for r in got]


def _predictor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel | None = shared.value
        for batch in batches:
            column = batch.column("text")
            rows = len(batch)
            # a letter in any script
            has = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, score = np.full(rows, UNKNOWN, dtype=object), np.zeros(rows)
            if model is not None:
                buf, off = text_buffers(column)
                for i, j in blocks(off, BLOCK_BYTES):
                    p = model.scores(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                    names[i:j] = np.array(model.languages, dtype=object)[p.argmax(axis=1)]
                    score[i:j] = p.max(axis=1)
                names[~has], score[~has] = UNKNOWN, 0.0
            accepted = has & (score >= (model.threshold if model else 1.1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names.tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(accepted)],
                ["doc_id", "held_out", "lang_pred", "score", "accepted"],
            )

    return run


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted (the score is at or above the calibrated limit) of every row."""
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col)
    bags, labels = _sample(rows)
    model = train(bags, labels) if bags else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    asked = rows.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return asked.mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
