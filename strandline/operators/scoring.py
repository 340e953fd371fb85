"""Scoring of predicted sequences and the summaries of scores."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.functions.text import candidate_actions, judge_digit, strip
from strandline.sources.files import cached


def pair_costs(pairs: DataFrame, vectors: DataFrame, key: str, vector: str, cost=S.scorer_cost) -> DataFrame:
    """(a, b, cost) of distinct item pairs; each pair is compared once however often it occurs."""
    distinct = pairs.select("a", "b").distinct()
    left = vectors.select(F.col(key).alias("a"), F.col(vector).alias("va"))
    right = vectors.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    return distinct.join(left, "a", "left").join(right, "b", "left").select("a", "b", cost(S.cosine(F.col("va"), F.col("vb"))).alias("cost"))


def cost_matrices(samples: DataFrame, ids: Sequence[str], gt: str, pred: str, vectors: DataFrame, key: str, vector: str, cost=S.scorer_cost) -> DataFrame:
    """Substitution costs of each sample as an array of rows."""
    cells = samples.select(*ids, F.posexplode(gt).alias("i", "a"), F.col(pred)).select(*ids, "i", "a", F.posexplode(pred).alias("j", "b"))
    priced = cells.join(pair_costs(cells, vectors, key, vector, cost), ["a", "b"], "left").withColumn("cost", F.coalesce("cost", F.lit(1.0)))
    # one aggregation by sample: the cells come in order, and are cut into rows as long as the prediction
    cells_in_order = F.transform(F.sort_array(F.collect_list(F.struct("i", "j", "cost"))), lambda c: c["cost"])
    flat = priced.groupBy(*ids).agg(cells_in_order.alias("flat"), (F.max("j") + 1).alias("n"))
    rows = F.transform(F.sequence(F.lit(0), (F.size("flat") / F.col("n")).cast("int") - 1), lambda i: F.slice("flat", i * F.col("n") + 1, F.col("n")))
    return flat.select(*ids, rows.alias("costs"))


def score_samples(samples: DataFrame, ids: Sequence[str], gt: str, pred: str, vectors: DataFrame, key: str, vector: str, cost=S.scorer_cost) -> DataFrame:
    """Adds sed and raw score to each sample (empty sequences included)."""
    matrices = cost_matrices(samples, ids, gt, pred, vectors, key, vector, cost)
    m, n = F.size(gt), F.size(pred)
    joined = samples.join(matrices, list(ids), "left")
    distance = F.when((m == 0) | (n == 0), F.greatest(m, n).cast("double")).otherwise(S.soft_edit_distance(F.col("costs"), n))
    return joined.withColumn("sed", distance).withColumn("raw", S.sed_score(F.col("sed"), m, n)).drop("costs")


def with_baseline(scores: DataFrame, baselines: DataFrame, on: Sequence[str], raw: str = "raw", baseline: str = "random_sed") -> DataFrame:
    """Left join of the baselines, and the normalised score from the unrounded raw one."""
    return scores.join(baselines, list(on), "left").withColumn("normalized", S.normalised(F.col(raw), F.col(baseline)))


def best_of(scores: DataFrame, ids: Sequence[str], raw: str, place: str) -> DataFrame:
    """The candidate with the largest rounded score, the first one among ties, and the number of candidates."""
    w = Window.partitionBy(*ids)
    ranked = scores.withColumn("rank", F.row_number().over(w.orderBy(F.round(raw, 4).desc(), F.col(place).asc()))).withColumn("n_candidates", F.count(F.lit(1)).over(w))
    return ranked.filter("rank = 1").drop("rank")


def cube_summary(scores: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean and sample deviation over all grouping sets; "ALL" marks a rolled-up column."""
    names = [F.when(F.grouping(c) == 1, F.lit("ALL")).otherwise(F.col(c)).alias(f"{c}_") for c in by]
    out = scores.cube(*by).agg(*names, F.count(value).alias("n"), F.round(F.avg(value), 4).alias("normalized"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("std"))
    return out.filter("n > 0").select(*[F.col(f"{c}_").alias(c) for c in by], "n", "normalized", F.coalesce("std", F.lit(0.0)).alias("std"))


def stats(scores: DataFrame, by: Sequence[str], value: str, error: Column | None = None, distance: str | None = None) -> DataFrame:
    """Mean, population deviation, median, least, most and number of errors; with a distance column its mean."""
    bad = F.count_if(error) if error is not None else F.lit(0).cast("long")
    more = [F.round(F.avg(distance), 4).alias("distance_mean")] if distance else []
    return scores.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("std"), F.round(F.median(value), 4).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"), bad.alias("errors"), *more
    )


def rollup_summary(scores: DataFrame, level: str, value: str) -> DataFrame:
    """Per level and overall, population deviation."""
    out = scores.rollup(level).agg(F.grouping(level).alias("g"), F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("std"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col(level)).alias(level), "n", "mean", "std")


def nearest_rank(by: Sequence[str], df: DataFrame, value: str, share: float = 0.9) -> DataFrame:
    """sorted[int(n * share)] per group, by rank: no group is collected."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("i", F.row_number().over(w.orderBy(value)) - 1).withColumn("c", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("i") == F.least(F.floor(F.col("c") * share), F.col("c") - 1)).select(*by, F.col("c").alias("n"), F.col(value).alias("p"))


def throughput(calls: DataFrame, by: Sequence[str], latency: str, wall: str, tokens: str) -> DataFrame:
    """Calls a second, effective parallelism and tokens a minute."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.try_divide(F.count(F.lit(1)), F.max(wall)), 4).alias("per_s"),
        F.round(F.try_divide(F.sum(latency), F.max(wall)), 4).alias("parallelism"),
        F.round(F.median(latency), 4).alias("median_s"),
        F.round(F.try_divide(F.sum(tokens) * 60, F.max(wall)), 2).alias("tokens_per_min"),
    )


def per_level_means(scores: DataFrame, raw: str = "raw", normalized: str = "normalized") -> DataFrame:
    """Mean and population deviation of both scores over all samples; null ones don't count."""
    of = lambda c, name: [F.round(F.avg(c), 4).alias(f"{name}_mean"), F.round(F.stddev_pop(c), 4).alias(f"{name}_std")]
    return scores.agg(F.count(F.lit(1)).alias("n"), *of(raw, "raw"), *of(normalized, "normalized"))


def validated(samples: DataFrame, id_col: str, lists: Sequence[str]) -> DataFrame:
    """Violations per sample: repeated id, missing or empty lists, blank elements."""
    repeated = F.count(F.lit(1)).over(Window.partitionBy(id_col)) > 1
    checks = [F.when(repeated, "duplicate id")]
    for c in lists:
        checks += [
            F.when(F.col(c).isNull(), f"{c} missing"),
            F.when(F.size(c) == 0, f"{c} empty"),
            F.when(F.exists(c, lambda x: x.isNull() | (strip(x) == "")), f"{c} has a blank"),
        ]
    return samples.withColumn("violations", F.array_compact(F.array(*checks)))


def refused(samples: DataFrame, id_col: str) -> DataFrame:
    """Validated samples without their violations; the job fails at the first one that has any."""
    message = F.concat(F.lit("sample "), F.coalesce(F.col(id_col).cast("string"), F.lit("?")), F.lit(": "), F.array_join("violations", ", "))
    checked = F.when(F.size("violations") > 0, F.raise_error(message)).otherwise(F.col(id_col))
    return samples.withColumn(id_col, checked.cast(samples.schema[id_col].dataType)).drop("violations")


def _listed(value: Column) -> Column:
    """A variant as texts: a scalar becomes a list, elements that are objects give their text (or themselves), and all are stripped."""
    kind = F.schema_of_variant(value)
    one = lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$", "string"))
    many = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: strip(one(v)))
    return F.when(kind.startswith("ARRAY"), many).when(~kind.isin("VOID"), F.array(strip(F.try_variant_get(value, "$", "string"))))


def normalised_samples(lines: DataFrame, line: str, line_no: str) -> DataFrame:
    """id, ground_truth, prediction and context of JSON lines, whichever of their names the fields have.

    A missing id is sample_ and the line's number (from 1).
    """
    v = F.parse_json(F.col(line))
    rows = lines.select(F.col(line_no).alias("_no"), v.alias("v"))
    field = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$.{n}", "variant") for n in names])
    text = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in names])
    return rows.select(
        F.coalesce(text("id", "point_id"), F.concat(F.lit("sample_"), F.col("_no").cast("string"))).alias("id"),
        _listed(field("ground_truth", "gt")).alias("ground_truth"),
        _listed(field("prediction", "pred")).alias("prediction"),
        F.coalesce(text("context"), F.lit("")).alias("context"),
    )


def step_range(samples: DataFrame, lists: Sequence[str]) -> DataFrame:
    """Least and most steps of any list."""
    return samples.select(F.least(*[F.size(c) for c in lists]).alias("a"), F.greatest(*[F.size(c) for c in lists]).alias("b")).agg(F.min("a").alias("least_steps"), F.max("b").alias("most_steps"))


def evaluate(samples: DataFrame, method: str = "both", vectors: DataFrame | None = None, judged: DataFrame | None = None) -> dict[str, DataFrame]:
    """Results and summaries of samples (id, ground_truth, prediction).

    ``vectors`` has (text, vector) of all texts, ``judged`` (gt, pred, score) of the pairs, 0 to 9
    or null. A method whose input isn't there is left out, as one without access is. ``results``
    has a struct per method; ``embedding`` and ``judge`` are the summaries.
    """
    if method not in ("embedding", "judge", "both"):
        raise ValueError(f"no method {method}")
    out: dict[str, DataFrame] = {}
    steps = {"n_steps_gt": F.size("ground_truth"), "n_steps_pred": F.size("prediction")}
    results = samples.select("id", "ground_truth", "prediction", *[c.alias(k) for k, c in steps.items()])
    if method != "judge" and vectors is not None:
        one = embedding_results(samples, vectors)
        out["embedding"] = stats(one.withColumn("method", F.lit("embedding")), ["method"], "score", F.lit(False), "soft_edit_distance")
        results = results.join(one.select("id", F.struct("score", "soft_edit_distance", "cosine_matrix").alias("embedding")), "id", "left")
    if method != "embedding" and judged is not None:
        two = judge_results(samples, judged)
        out["judge"] = stats(two.withColumn("method", F.lit("judge")), ["method"], "score", F.col("has_error"), "soft_edit_distance")
        results = results.join(two.select("id", F.struct("score", "soft_edit_distance", "judge_matrix", "has_error").alias("judge")), "id", "left")
    return {"results": results} | out


def _cells(samples: DataFrame) -> DataFrame:
    """(id, i, j, a, b) of every pair of a ground truth's and a prediction's step."""
    rows = samples.select("id", "prediction", F.posexplode("ground_truth").alias("i", "a"))
    return rows.select("id", "i", "a", F.posexplode("prediction").alias("j", "b"))


def _matrices(cells: DataFrame, *values: str) -> DataFrame:
    """Each value's matrix per sample, rows in the order of the ground truth."""
    rows = cells.groupBy("id", "i").agg(*[F.transform(F.sort_array(F.collect_list(F.struct("j", F.struct(F.col(v).alias("v")).alias("c")))), lambda x: x["c"]["v"]).alias(v) for v in values])
    return rows.groupBy("id").agg(*[F.transform(F.sort_array(F.collect_list(F.struct("i", F.struct(F.col(v).alias("v")).alias("c")))), lambda x: x["c"]["v"]).alias(v) for v in values])


def _results(samples: DataFrame, matrices: DataFrame, *more: str) -> DataFrame:
    m, n = F.size("ground_truth"), F.size("prediction")
    distance = F.when((m == 0) | (n == 0), F.greatest(m, n).cast("double")).otherwise(S.soft_edit_distance(F.col("cost"), n))
    rows = samples.select("id", "ground_truth", "prediction").join(matrices, "id", "left").withColumn("distance", distance)
    score = F.round(S.sed_score(F.col("distance"), m, n), 4).alias("score")
    return rows.select("id", score, F.round("distance", 4).alias("soft_edit_distance"), *more)


def embedding_results(samples: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, score, soft_edit_distance and cosine_matrix by the vectors (text, vector) of the texts."""
    cells = _cells(samples)
    left, right = (vectors.select(F.col("text").alias(k), F.col("vector").alias(f"v{k}")) for k in "ab")
    cosine = F.least(F.greatest(S.cosine(F.col("va"), F.col("vb")), F.lit(-1.0)), F.lit(1.0))
    pairs = cells.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", cosine.alias("cosine"))
    priced = cells.join(pairs, ["a", "b"]).select("id", "i", "j", (1 - F.col("cosine")).alias("cost"), F.round("cosine", 4).alias("cosine_matrix"))
    return _results(samples, _matrices(priced, "cost", "cosine_matrix"), "cosine_matrix")


def judge_pairs(samples: DataFrame, order: str) -> DataFrame:
    """Distinct (gt, pred) pairs with the context of the sample, by order, that has them first."""
    rows = samples.select(order, "context", F.explode("ground_truth").alias("gt"), "prediction").select(order, "context", "gt", F.explode("prediction").alias("pred"))
    return rows.groupBy("gt", "pred").agg(F.min_by("context", order).alias("context"))


def judge_results(samples: DataFrame, judged: DataFrame) -> DataFrame:
    """id, score, soft_edit_distance, judge_matrix and has_error by the pairs' scores (gt, pred, score)."""
    known = judged.select(F.col("gt").alias("a"), F.col("pred").alias("b"), F.col("score").alias("judge_matrix"))
    cells = _cells(samples).join(known, ["a", "b"], "left").withColumn("cost", S.judge_cost(F.col("judge_matrix")))
    rows = _results(samples, _matrices(cells, "cost", "judge_matrix"), "judge_matrix")
    return rows.withColumn("has_error", F.coalesce(F.exists("judge_matrix", lambda r: F.exists(r, lambda x: x.isNull())), F.lit(False)))


def embedded(requests: DataFrame, provider: Callable[[list[str]], list[list[float]]], cache: DataFrame, text: str = "text", batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(text, vector) of the distinct texts, and the rows to add to the cache (key, vector).

    The cache serves what it has; ``provider`` gets the others, ``batch`` at a time.
    """
    have, missing = cached(requests, cache, text)

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                yield pd.DataFrame({"text": part["text"], "key": part["key"], "vector": provider(part["text"].tolist())})

    fresh = missing.select(F.col(text).alias("text"), "key").mapInPandas(fetch, "text string, key string, vector array<double>")
    both = have.select(F.col(text).alias("text"), F.transform("vector", lambda x: x.cast("double")).alias("vector")).unionByName(fresh.select("text", "vector"))
    return both, fresh.select("key", "vector")


def score_batch(samples: DataFrame, vectors: DataFrame, baselines: DataFrame) -> DataFrame:
    """Scores of samples (id, ground_truth, prediction, all_predictions, level, k): the best candidate where there are several lists, else the one prediction.

    A missing k is the prediction's length. ``baselines`` has (level, k, random_sed). A sample with neither prediction nor candidates fails the job.
    """
    several = F.size(F.coalesce("all_predictions", F.array())) > 0
    choices = F.when(several, F.col("all_predictions")).when(F.col("prediction").isNotNull(), F.array("prediction")).otherwise(F.raise_error(F.concat(F.lit("nothing predicted for "), F.col("id").cast("string"))))
    rows = samples.select("id", "ground_truth", "level", "k", several.alias("several"), F.posexplode(choices).alias("candidate", "prediction"))
    rows = rows.withColumn("k", F.coalesce("k", F.size("prediction")))
    scored = score_samples(rows, ["id", "candidate"], "ground_truth", "prediction", vectors, "text", "vector")
    best = best_of(with_baseline(scored, baselines, ["level", "k"]), ["id"], "raw", "candidate")
    return best.select(
        "id", F.round("raw", 4).alias("raw"), "normalized", "level", "k", F.size("ground_truth").alias("gt_len"), F.size("prediction").alias("pr_len"), F.col("random_sed").alias("random_baseline"),
        F.when(F.col("several"), F.col("n_candidates")).alias("n_candidates"),
    )


def _tried(ask: Callable[..., object], retries: int, wait: Callable[[float], None], *args: object) -> object | None:
    """The answer of the first call that gives one; None if none does."""
    for attempt in range(retries):
        try:
            answer = ask(*args)
            if answer is not None:
                return answer
        except Exception:  # noqa: BLE001 - a provider may fail in any way
            pass
        if attempt + 1 < retries:
            wait(1.0 + attempt)
    return None


def judged(pairs: DataFrame, judge: Callable[[str, str, str], str], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(gt, pred, context) -> (gt, pred, score): the digit in the judge's reply, null if it gives none after all tries."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = [_tried(judge, retries, wait, *row) for row in f[["gt", "pred", "context"]].itertuples(index=False)]
            yield pd.DataFrame({"gt": f["gt"], "pred": f["pred"], "reply": pd.Series(replies, index=f.index, dtype=object)})

    return pairs.select("gt", "pred", "context").mapInPandas(ask, "gt string, pred string, reply string").select("gt", "pred", judge_digit(F.col("reply")).alias("score"))


def predicted(points: DataFrame, model: Callable[[str, str], str], k: int, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, system, user, ground_truth) -> (id, ground_truth, all_predictions) by a model's replies, in order of id.

    A point whose replies hold no candidate after all tries is left out, as it can't be scored; ``captions.coverage`` tells how many are.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies = [_tried(lambda a, b: (r := model(a, b)) and ("actions" in r) and r or None, retries, wait, *row) for row in f[["system", "user"]].itertuples(index=False)]
            yield pd.DataFrame({"id": f["id"], "ground_truth": f["ground_truth"], "reply": pd.Series(replies, index=f.index, dtype=object)})

    rows = points.select(F.col("id").cast("string").alias("id"), "system", "user", F.slice("ground_truth", 1, k).alias("ground_truth"))
    found = rows.mapInPandas(ask, "id string, ground_truth array<string>, reply string")
    return found.select("id", "ground_truth", candidate_actions(F.col("reply"), k).alias("all_predictions")).filter(F.size("all_predictions") > 0).orderBy("id")


def register(spark: SparkSession) -> None:
    """Makes soft_edit_distance(costs, width) and sed_score(distance, left, right) known to SQL, as expressions."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION soft_edit_distance(costs ARRAY<ARRAY<DOUBLE>>, width INT) RETURNS DOUBLE RETURN
        IF(width = 0, CAST(size(costs) AS DOUBLE), element_at(aggregate(costs, transform(sequence(0, width), j -> CAST(j AS DOUBLE)),
          (above, r) -> aggregate(sequence(1, width), array(get(above, 0) + 1), (now, j) -> concat(now, array(least(get(above, j) + 1, get(now, j - 1) + 1, get(above, j - 1) + get(r, j - 1)))))), -1))"""
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sed_score(distance DOUBLE, a INT, b INT) RETURNS DOUBLE RETURN IF(greatest(a, b) = 0, 1.0D, 1 - distance / greatest(a, b, 1))")
