"""Queries of evaluation points, samples and their scores. A user is a participant, a day of theirs a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import scoring, timeline
from strandline.plans import base
from strandline.plans.base import events, query, table
from strandline.sources import files

def _id() -> Column:
    return F.col("event_id")


def _text(c: Column) -> Column:
    return c.cast("string")


def _days(spark: SparkSession, d: str) -> DataFrame:
    """Events with their day, line in it, and place in the user's timeline."""
    e = events(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    e = timeline.positions(e, ["user_id"], ["ts", "event_id"]).drop("pos_count")
    return e.withColumn("line_no", (F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")) - 1).cast("long"))


def _recordings(e: DataFrame) -> DataFrame:
    return e.select("user_id", F.col("day").alias("recording")).distinct().withColumn("rec_no", F.row_number().over(Window.partitionBy("user_id").orderBy("recording")))


_TIMES = """e AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS line_no FROM events),
r AS (SELECT user_id, day, min(pos) AS first_pos, max(pos) AS last_pos, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rec_no FROM e GROUP BY user_id, day),
p AS (SELECT a.user_id, a.day, a.last_pos, b.first_pos AS gt_pos FROM r a LEFT JOIN r b ON b.user_id = a.user_id AND b.rec_no = a.rec_no + 3)"""


@query(
    f"""WITH {_TIMES} SELECT p.user_id, p.day AS context_recording, coalesce(string_agg(e.event_id, ',' ORDER BY e.pos), '') AS context FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.pos > p.last_pos - 12
 AND (e.pos <= p.last_pos OR (p.last_pos < 11 AND e.pos <= 11 AND e.pos < coalesce(p.gt_pos, 0))) GROUP BY ALL"""
)
def recording_context(spark, d):
    """Twelve events up to the end of each day, filled up from later days but for those from the third next one on."""
    e = _days(spark, d)
    rec = _recordings(e)
    bounds = timeline.recording_bounds(e.withColumnRenamed("day", "recording"), rec, ["user_id"])
    third = rec.select("user_id", F.col("recording").alias("gt_first"), (F.col("rec_no") - 3).alias("rec_no"))
    points = rec.join(third, ["user_id", "rec_no"], "left").select("user_id", F.col("recording").alias("context_recording"), "gt_first")
    out = timeline.recording_context(points, e, bounds, ["user_id"], 12, "event_id")
    return out.select("user_id", "context_recording", F.array_join(F.transform("context", _text), ",").alias("context"))


@query(
    f"""WITH {_TIMES}, g AS (SELECT r.user_id, r.day, r.last_pos, count(*) AS n, string_agg(e.event_id, ',' ORDER BY e.pos) AS own FROM r JOIN e ON e.user_id = r.user_id AND e.day = r.day GROUP BY ALL)
SELECT g.user_id, g.day AS gt_last, own || coalesce(',' || string_agg(e.event_id, ',' ORDER BY e.pos), '') AS ground_truth FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.pos > g.last_pos AND e.pos <= g.last_pos + 10 - n GROUP BY g.user_id, g.day, own"""
)
def recording_truth(spark, d):
    """Each day's events as a ground truth, short ones filled up to ten from the days behind."""
    e = _days(spark, d)
    bounds = timeline.recording_bounds(e.withColumnRenamed("day", "recording"), _recordings(e), ["user_id"])
    own = e.groupBy("user_id", "day").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "event_id"))), lambda x: x["event_id"]).alias("ground_truth"))
    out = timeline.extended_truth(own.withColumnRenamed("day", "gt_last"), e, bounds, ["user_id"], 10, "event_id")
    return out.select("user_id", "gt_last", F.array_join(F.transform("ground_truth", _text), ",").alias("ground_truth"))


@query(
    f"""WITH {_TIMES}, q AS (SELECT user_id, day, user_id % 5 AS cutoff_line, first_pos + least(user_id % 5, last_pos - first_pos + 1) AS at FROM r), f AS (SELECT q.user_id, q.day, q.cutoff_line, e.event_id, e.pos, e.day AS of_day, e.line_no FROM q LEFT JOIN e ON e.user_id = q.user_id AND e.pos >= q.at AND e.pos < q.at + 10),
s AS (SELECT user_id, day, cutoff_line, of_day, min(line_no) AS first_line, count(*) AS n FROM f WHERE event_id IS NOT NULL GROUP BY ALL)
SELECT f.user_id, f.day, coalesce(string_agg(f.event_id, ',' ORDER BY f.pos), '') AS ground_truth, coalesce((SELECT string_agg(of_day || ':' || first_line || ':' || n, ',' ORDER BY of_day) FROM s WHERE s.user_id = f.user_id AND s.day = f.day), '') AS spans FROM f GROUP BY f.user_id, f.day"""
)
def truth_across_days(spark, d):
    e = _days(spark, d)
    points = e.select("user_id", "day").distinct().withColumn("cutoff_line", F.col("user_id") % 5)
    out = timeline.truth_from_cutoff(points, e, ["user_id"], 10, "event_id")
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["day"], _text(s["first_line"]), _text(s["n"])))
    return out.select("user_id", "day", F.array_join(F.transform("ground_truth", _text), ",").alias("ground_truth"), F.array_join(shown, ",").alias("spans"))


@query("SELECT user_id, coalesce(min_by(event_type, event_id) FILTER (WHERE value >= 1), '??:??:??') AS start, coalesce(max_by(event_type, event_id) FILTER (WHERE value >= 1), '??:??:??') AS \"end\" FROM events GROUP BY user_id")
def known_time_bounds(spark, d):
    known = F.when(F.col("value") >= 1, F.col("event_type"))
    rows = events(spark, d).select("user_id", "event_id", known.alias("s"), known.alias("e"))
    return timeline.time_bounds(rows, ["user_id"], "event_id", "s", "e")


@query("SELECT event_id, printf('eval_%04d', row_number() OVER (ORDER BY user_id, event_id) - 1) AS id FROM events")
def evaluation_ids(spark, d):
    return timeline.numbered_ids(events(spark, d).select("user_id", "event_id"), ["user_id", "event_id"]).select("event_id", "id")


@query("SELECT event_id, pos FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n > 53 AND pos >= 50 AND pos < n - 3")
def eligible_cutoffs(spark, d):
    rows = timeline.positions(events(spark, d), ["user_id"], ["ts", "event_id"])
    return timeline.eligible(rows, 50, 3, 53).select("event_id", F.col("pos").cast("long").alias("pos"))


@query("SELECT user_id FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY 1) WHERE a >= 8 AND b >= 8")
def viable_points(spark, d):
    of = lambda k: F.collect_list(F.when(F.col("event_type") == k, _id()))
    rows = events(spark, d).groupBy("user_id").agg(of("click").alias("a"), of("purchase").alias("b"))
    return timeline.complete(rows, "a", "b", least=8).select("user_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= user_id % 4")
def quota_points(spark, d):
    rows = events(spark, d).withColumn("quota", F.col("user_id") % 4)
    return timeline.first_of_quota(rows, ["user_id"], ["event_id"], "quota").select("user_id", "event_id")


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 100 OFFSET 30")
def benchmark_page(spark, d):
    return files.page(events(spark, d).select("event_id"), "event_id", 30, 100)


@query("SELECT vec_id, round(sqrt(list_dot_product(x, x)), 6) AS norm, round(x[1] / greatest(sqrt(list_dot_product(x, x)), 1e-10), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)")
def unit_vectors(spark, d):
    v = table(spark, d, "embeddings")
    x = F.col("embedding")
    return v.select("vec_id", F.round(F.sqrt(S.dot(x, x)), 6).alias("norm"), F.round(F.get(S.unit(x), F.lit(0)), 6).alias("first"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Samples as JSON lines, in all the forms that they come in."""
    action = F.col("event_type")
    quoted = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kinds = [
        quoted('{"id": "s', _text(_id()), '", "ground_truth": ["', action, ' ", "b"], "prediction": ["c"], "context": "x"}'),
        quoted('{"point_id": "s', _text(_id()), '", "gt": "', action, '", "pred": [{"text": "c"}, {"text": " d "}]}'),
        quoted('{"gt": ["', action, '"], "prediction": "c", "id": ', _text(_id()), "}"),
        quoted('{"ground_truth": ["', action, '"], "pred": ["c"]}'),
    ]
    line = F.coalesce(*[F.when(_id() % 4 == k, c) for k, c in enumerate(kinds)])
    return events(spark, d).select("event_id", line.alias("line"))


@query(
    """SELECT CASE event_id % 4 WHEN 0 THEN 's' || event_id WHEN 1 THEN 's' || event_id WHEN 2 THEN CAST(event_id AS VARCHAR) ELSE 'sample_' || event_id END AS id,
CASE event_id % 4 WHEN 0 THEN event_type || '|b' ELSE event_type END AS ground_truth, CASE event_id % 4 WHEN 1 THEN 'c|d' ELSE 'c' END AS prediction, CASE event_id % 4 WHEN 0 THEN 'x' ELSE '' END AS context FROM events"""
)
def normalised_samples(spark, d):
    rows = scoring.refused(scoring.validated(scoring.normalised_samples(_lines(spark, d), "line", "event_id"), "id", ["ground_truth", "prediction"]), "id")
    return rows.select("id", F.array_join("ground_truth", "|").alias("ground_truth"), F.array_join("prediction", "|").alias("prediction"), "context")


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'a empty' WHEN 2 THEN 'b missing' WHEN 3 THEN 'a has a blank' ELSE '' END AS violations FROM events")
def sample_violations(spark, d):
    a = F.when(_id() % 4 == 1, F.array().cast("array<string>")).when(_id() % 4 == 3, F.array(F.lit("x"), F.lit(" "))).otherwise(F.array(F.lit("x")))
    rows = events(spark, d).select("event_id", a.alias("a"), F.when(_id() % 4 != 2, F.array(F.lit("y"))).alias("b"))
    return scoring.validated(rows, "event_id", ["a", "b"]).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT CAST(min(least(n, m)) AS INT) AS least_steps, CAST(max(greatest(n, m)) AS INT) AS most_steps FROM (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS m FROM events GROUP BY 1)")
def step_ranges(spark, d):
    rows = events(spark, d).groupBy("user_id").agg(F.collect_list("event_type").alias("a"), F.collect_list(F.when(F.col("event_type") == "click", _id())).alias("b"))
    return scoring.step_range(rows, ["a", "b"])


def _samples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from strandline.plans import registry

    p = registry.points(spark, d).select(_text(_id()).alias("id"), "ground_truth", "prediction", F.lit("").alias("context"))
    return p, registry.action_vectors(spark, d).select(F.col("event_type").alias("text"), F.col("embedding").alias("vector"))


def _scored_sql(cost: str) -> str:
    from strandline.plans import registry

    k = base.K
    cells = ", ".join(f"(SELECT {cost} FROM c WHERE a = ground_truth[{i}] AND b = prediction[{j}]) AS c_{i}_{j}" for i in range(1, k + 1) for j in range(1, k + 1))
    return f"s0 AS (SELECT event_id, {cells} FROM p), s1 AS (SELECT *, {registry._sql_sed(k, k)} FROM s0), s AS (SELECT event_id, round(1 - d_{k}_{k} / {k}, 4) AS score, round(d_{k}_{k}, 4) AS soft_edit_distance FROM s1)"


def _windowed() -> str:
    from strandline.plans import registry

    return registry._WINDOWED


_COSINE = "c AS (SELECT a.event_type AS a, b.event_type AS b, 1 - least(greatest(list_dot_product(a.x, b.x) / (greatest(sqrt(list_dot_product(a.x, a.x)), 1e-10) * greatest(sqrt(list_dot_product(b.x, b.x)), 1e-10)), -1.0), 1.0) AS cost FROM v a, v b)"
_JUDGED = "CASE WHEN (length(a) * 3 + length(b)) % 11 > 9 THEN NULL ELSE (length(a) * 3 + length(b)) % 11 END"


def _judged(samples: DataFrame) -> DataFrame:
    digit = (F.char_length("gt") * 3 + F.char_length("pred")) % 11
    return scoring.judge_pairs(samples, "id").select("gt", "pred", F.when(digit <= 9, digit).alias("score"))


def _embedding_sql() -> str:
    head = _windowed().rsplit("c AS (SELECT", 1)[0]
    return f"WITH {head}{_COSINE}, {_scored_sql('cost')}"


def _judge_sql() -> str:
    head = _windowed().rsplit("c AS (SELECT", 1)[0]
    pairs = f"c AS (SELECT a.event_type AS a, b.event_type AS b, coalesce(1 - {_JUDGED.replace('(a)', '(a.event_type)').replace('(b)', '(b.event_type)')} / 9.0, 1.0) AS cost FROM kinds a, kinds b)"
    return f"WITH {head}{pairs}, {_scored_sql('cost')}"


def evaluation_by_embedding(spark, d):
    samples, vectors = _samples(spark, d)
    return scoring.evaluate(samples, "embedding", vectors)["results"].select(F.col("id").cast("long").alias("event_id"), "embedding.score", "embedding.soft_edit_distance")


def evaluation_by_judge(spark, d):
    samples, _ = _samples(spark, d)
    return scoring.evaluate(samples, "judge", judged=_judged(samples))["results"].select(F.col("id").cast("long").alias("event_id"), "judge.score", "judge.soft_edit_distance")


def evaluation_summary(spark, d):
    samples, vectors = _samples(spark, d)
    out = scoring.evaluate(samples, "both", vectors, _judged(samples))
    return out["embedding"].unionByName(out["judge"]).select("method", "n", "mean", "std", "low", "high", "distance_mean")


def scored_batch(spark, d):
    """Two candidates a point, the repeated last steps and the same backwards, against the baselines of the levels."""
    samples, vectors = _samples(spark, d)
    rows = samples.select(
        "id", "ground_truth", F.when(F.col("id").cast("long") % 3 == 0, F.col("prediction")).alias("prediction"),
        F.when(F.col("id").cast("long") % 3 != 0, F.array("prediction", F.reverse("prediction"))).alias("all_predictions"), F.concat(F.lit("L"), _text(F.col("id").cast("long") % 2 + 1)).alias("level"), F.lit(None).cast("int").alias("k"),
    )
    base_ = spark.createDataFrame([("L1", 3, 0.4)], "level string, k int, random_sed double")
    return scoring.score_batch(rows, vectors, base_).select(F.col("id").cast("long").alias("event_id"), "raw", "normalized", "level", "k", F.col("n_candidates").cast("long").alias("n_candidates"))


def _batch_sql() -> str:
    from strandline.plans import registry

    k = base.K
    cell = lambda i, j, back: f"(SELECT cost FROM c WHERE a = ground_truth[{i}] AND b = prediction[{k + 1 - j if back else j}]) AS c_{i}_{j}"
    side = lambda back: f"(SELECT event_id, {int(back)} AS candidate, {', '.join(cell(i, j, back) for i in range(1, k + 1) for j in range(1, k + 1))} FROM p{' WHERE event_id % 3 <> 0' if back else ''})"
    return f"""WITH {_windowed()}, s0 AS (SELECT * FROM {side(False)} UNION ALL SELECT * FROM {side(True)}), s1 AS (SELECT *, {registry._sql_sed(k, k)} FROM s0), s AS (SELECT event_id, candidate, 1 - d_{k}_{k} / {k} AS r FROM s1),
t AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(r, 4) DESC, candidate) AS i FROM s)
SELECT event_id, round(r, 4) AS raw, CASE WHEN event_id % 2 = 0 THEN round(greatest(0.0, (r - 0.4) / 0.6), 4) END AS normalized, 'L' || (event_id % 2 + 1) AS level, {k} AS k, CASE WHEN event_id % 3 <> 0 THEN 2 END AS n_candidates FROM t WHERE i = 1"""


query(f"{_embedding_sql()} SELECT * FROM s")(evaluation_by_embedding)
query(f"{_judge_sql()} SELECT * FROM s")(evaluation_by_judge)
query(
    f"SELECT 'embedding' AS method, count(*) AS n, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, min(score) AS low, max(score) AS high, round(avg(soft_edit_distance), 4) AS distance_mean FROM ({_embedding_sql()} SELECT * FROM s) UNION ALL SELECT 'judge', count(*), round(avg(score), 4), round(stddev_pop(score), 4), min(score), max(score), round(avg(soft_edit_distance), 4) FROM ({_judge_sql()} SELECT * FROM s)"
)(evaluation_summary)
query(_batch_sql())(scored_batch)


@query("SELECT count(*) AS n, round(avg(value), 4) AS raw_mean, round(stddev_pop(value), 4) AS raw_std, round(avg(CASE WHEN value >= 1 THEN value END), 4) AS normalized_mean, round(stddev_pop(CASE WHEN value >= 1 THEN value END), 4) AS normalized_std FROM events")
def score_means(spark, d):
    return scoring.per_level_means(events(spark, d).withColumn("n", F.when(F.col("value") >= 1, F.col("value"))), "value", "n")


def evaluation_in_sql(spark, d):
    """Scores of the embedding evaluation, by the functions that SQL knows."""
    samples, vectors = _samples(spark, d)
    scoring.register(spark)
    matrices = scoring.embedding_results(samples, vectors).join(samples.select("id", "ground_truth", "prediction"), "id")
    costs = F.expr("transform(cosine_matrix, r -> transform(r, c -> 1 - c))")
    rows = matrices.withColumn("costs", costs).withColumn("sed", F.expr("soft_edit_distance(costs, size(prediction))"))
    near = F.abs(F.expr("sed_score(sed, size(ground_truth), size(prediction))") - F.col("score")) < 0.001
    return rows.select(F.col("id").cast("long").alias("event_id"), near.alias("near"))


query(f"{_embedding_sql()} SELECT event_id, true AS near FROM s")(evaluation_in_sql)
