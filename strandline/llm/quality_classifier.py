"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade > k) = sigmoid(w.x - t_k): one weight vector over hashed words and a few
shape figures serves all grades, and ordered thresholds (first one free, the
others by positive steps) separate them. Grades come from the labels: 0 toxic, 1
poor, 2 good. The model gives the expected grade and the tail probabilities; documents
are selected on the probability of the best grade, with a limit that is calibrated on
labelled rows kept from training. It is fitted by stochastic gradient descent on a
bounded sample of the labelled rows (``SAMPLE_ROWS``, by hash), whose whole texts
executors turn into buckets. The weights have a fixed size and are broadcast; scoring
reads whole texts, once, without a shuffle.

Defined cases: null text counts as empty and gets the grade of no features; a
label row with a null grade isn't learned from; without usable labels the weights
are zero; ids that repeat in documents or labels are scored, or learned, each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.cluster import only
from strandline.llm.hashed_text import hashed_words
from strandline.llm.textbuf import blocks, text_buffers

BUCKETS = 1 << 20
#: Buckets get a weight if they are in this many training texts and tell the grades apart by this many standard errors.
LEAST_TEXTS = 8
LEAST_Z = 5.0
GRADES = 3
EPOCHS = 6
RATE = 1.0
DECAY = 1e-4
SAMPLE_ROWS = 8_000
#: Share of the sample that the selection limit is calibrated on.
CALIBRATION_PERCENT = 20
#: Documents whose probability of a grade over 0 is below are never selected.
LEAST_TAIL = 0.5
BLOCK_BYTES = 1 << 18
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in "#*$%&|<>!"]] = True
SHAPES = 3
SCALE = 0.5


def _features(buf: np.ndarray, off: np.ndarray) -> tuple:
    """Hashed words and shape figures: share of marks, of capitals, and of words that repeat."""
    bags = hashed_words(buf, off, BUCKETS)
    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off), 1)

    marks, capitals = share(_MARKS[buf]), share((buf >= 0x41) & (buf <= 0x5A))
    doc = np.repeat(np.arange(len(off) - 1), bags.counts)
    distinct = np.bincount(np.unique(doc * BUCKETS + bags.index) // BUCKETS, minlength=len(off) - 1) if len(doc) else np.zeros(len(off) - 1)
    repeats = 1 - distinct / np.maximum(bags.counts, 1)
    return bags, np.stack([10 * marks, 4 * capitals, repeats], axis=1)


class OrdinalModel:
    def __init__(self):
        self.w = np.zeros(BUCKETS)
        self.shape = np.zeros(SHAPES)
        self.first, self.steps = -1.0, np.zeros(GRADES - 2)
        self.learned = np.zeros(BUCKETS, dtype=bool)
        self.select_at = 0.5

    def calibrate(self, score: np.ndarray, good: np.ndarray) -> None:
        """Sets the limit on P(best grade) at which the shares of good rows kept and of others dropped are largest together."""
        p = self.tails(score)[:, -1]
        n_good, n_other = int(good.sum()), int((~good).sum())
        if not n_good or not n_other:
            return
        rank = np.argsort(-p, kind="stable")
        gain = np.cumsum(np.where(good[rank], 1 / n_good, -1 / n_other))
        last = np.append(p[rank][1:] != p[rank][:-1], True)  # equal ones are selected together
        best = int(np.argmax(np.where(last, gain, -np.inf)))
        below = p[rank][best + 1] if best + 1 < len(p) else 0.0
        self.select_at = float((p[rank][best] + below) / 2)

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.steps))])

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        bags, shapes = _features(buf, off)
        return _distinct_sums(bags, self.w, self.learned) + shapes @ self.shape


def _distinct_sums(bags, w: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """Sum of the weights of each bag's distinct learned buckets, scaled."""
    rows = len(bags.first) - 1
    if not len(bags.index):
        return np.zeros(rows)
    key = np.repeat(np.arange(rows), bags.counts) * BUCKETS + bags.index
    key = np.unique(key[learned[bags.index]])
    doc = key // BUCKETS
    return SCALE * np.bincount(doc, weights=w[key % BUCKETS], minlength=rows)


def _telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets whose texts' grades differ from all texts' by ``LEAST_Z`` standard errors for some grade."""
    if not rows:
        return np.zeros(BUCKETS, dtype=bool)
    flat, size = np.concatenate(rows), [len(r) for r in rows]
    n = np.bincount(flat, minlength=BUCKETS)
    out = np.zeros(BUCKETS, dtype=bool)
    for g in range(GRADES):
        is_g = (y == g).astype(float)
        share = is_g.mean()
        hits = np.bincount(flat, weights=np.repeat(is_g, size), minlength=BUCKETS)
        z = (hits - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
        out |= (np.abs(z) >= LEAST_Z) & (n >= LEAST_TEXTS)
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], seed: int = 11) -> OrdinalModel:
    """Fits weights and thresholds on the larger part of the rows (distinct buckets, shape figures), the selection limit on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows)).tolist()
    apart = order[: len(rows) * CALIBRATION_PERCENT // 100]
    fit = order[len(apart) :]
    model = _fitted([rows[d] for d in fit], [grades[d] for d in fit], rng)
    if apart:
        score = np.array([SCALE * model.w[i[model.learned[i]]].sum() + s @ model.shape for i, s in (rows[d] for d in apart)])
        model.calibrate(score, np.array([grades[d] for d in apart]) == GRADES - 1)
    return model


def _fitted(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], rng: np.random.Generator) -> OrdinalModel:
    model = OrdinalModel()
    y = np.array(grades)
    model.learned = _telling([i for i, _ in rows], y)
    rows = [(i[model.learned[i]], s) for i, s in rows]
    weight = {g: len(y) / (GRADES * max(1, int((y == g).sum()))) for g in range(GRADES)}
    squares = np.full(BUCKETS, 1e-2)
    done, steps = 0, max(1, EPOCHS * len(rows))
    for _ in range(EPOCHS):
        for d in rng.permutation(len(rows)).tolist():
            index, shapes = rows[d]
            rate = RATE * (1 - done / steps)
            done += 1
            scale = SCALE
            s = model.w[index].sum() * scale + shapes @ model.shape
            t = model.thresholds
            tail = 1 / (1 + np.exp(-np.clip(s - t, -40, 40)))
            g = int(y[d])
            # likelihood of grade g: P(> g-1) - P(> g)
            above, over = (tail[g - 1] if g else 1.0), (tail[g] if g < GRADES - 1 else 0.0)
            p = max(above - over, 1e-6)
            slope = np.zeros(GRADES - 1)  # of log p by each s - t_k
            if g:
                slope[g - 1] += above * (1 - above) / p
            if g < GRADES - 1:
                slope[g] -= over * (1 - over) / p
            slope = np.clip(slope, -3, 3) * min(4.0, weight[g])
            grad = slope.sum()
            step = grad * scale
            squares[index] += step * step
            model.w[index] += rate * (step / np.sqrt(squares[index]) - DECAY * model.w[index])
            model.shape += 0.1 * rate * grad * shapes
            model.first -= 0.1 * rate * grad
            for k in range(GRADES - 2):
                model.steps[k] = np.clip(model.steps[k] - 0.05 * rate * slope[k + 1 :].sum() * np.exp(model.steps[k]), -3.0, 2.0)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts as distinct buckets and shape figures."""
    for batch in batches:
        buf, off = text_buffers(batch.column("text"))
        index, shape = [], []
        for i, j in blocks(off, BLOCK_BYTES):
            bags, shapes = _features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            index += [np.unique(bags.index[a:b]).astype("<u4").tobytes() for a, b in zip(bags.first.tolist(), bags.first[1:].tolist(), strict=False)]
            shape += [x.astype("<f8").tobytes() for x in shapes]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("grade"), pa.array(index, pa.binary()), pa.array(shape, pa.binary())], ["place", "grade", "index", "shape"])


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: OrdinalModel = shared.value
        for batch in batches:
            buf, off = text_buffers(batch.column("text"))
            tails = np.zeros((len(batch), GRADES - 1))
            for i, j in blocks(off, BLOCK_BYTES):
                tails[i:j] = model.tails(model.score(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]), pa.array((tails[:, -1] >= model.select_at) & (tails[:, 0] >= LEAST_TAIL))],
                ["doc_id", "expected_grade", "p_not_toxic", "p_good", "kept"],
            )

    return run


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """doc_id, expected_grade, p_not_toxic, p_good and kept of every row."""
    spark = docs.sparkSession
    rows = only(docs, doc_id=id_col, text=text_col)
    graded = only(labels, doc_id=id_col, quality=quality_col, toxic=toxic_col).dropna().select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).alias("grade"))
    total = graded.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1 << 30)) / float(1 << 30)
    chosen = graded.withColumn("place", place).filter(F.col("place") < min(1.0, SAMPLE_ROWS / max(1, total))).orderBy("place", "doc_id", "grade").limit(2 * SAMPLE_ROWS)
    bags = rows.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("place", "grade", "text").mapInArrow(_bags, "place double, grade int, index binary, shape binary")
    got = bags.orderBy("place", "grade", "index", "shape").limit(2 * SAMPLE_ROWS).collect()
    model = train([(np.frombuffer(bytes(r[2]), dtype="<u4").astype(np.int64), np.frombuffer(bytes(r[3]), dtype="<f8")) for r in got], [r[1] for r in got])
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "doc_id long, expected_grade double, p_not_toxic double, p_good double, kept boolean")
