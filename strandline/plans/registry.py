"""Queries over the driver's tables, each with its SQL where SQL can express it.

Roles: events are action timelines (a user is a participant), embeddings are
action vectors, documents caption texts, orders clips and lineitem segments,
customers recordings, labels the clips that are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.functions import text as X
from strandline.operators import captions, joins, redact, scoring, timeline
from strandline.plans import base
from strandline.plans.base import CONTEXT, K, events, query, table

def queries() -> dict[str, base.Query]:
    from strandline.plans import clips, points, texts  # noqa: F401 - each adds its queries

    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    queries()
    return dict(base.ORACLES)


def _sql_sed(m: int, n: int, cost: str = "c") -> str:
    """Soft edit distance over cost columns c_i_j, unrolled, for a select list with earlier aliases in reach."""
    cell = lambda i, j: str(float(i or j)) if not (i and j) else f"d_{i}_{j}"
    return ", ".join(f"least({cell(i - 1, j)} + 1, {cell(i, j - 1)} + 1, {cell(i - 1, j - 1)} + {cost}_{i}_{j}) AS d_{i}_{j}" for i in range(1, m + 1) for j in range(1, n + 1))


_WINDOWED = f"""
e AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS pos_count,
        list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {CONTEXT} PRECEDING AND 1 PRECEDING) AS context,
        list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND {K - 1} FOLLOWING) AS ground_truth
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, list_slice(context, len(context) - {K - 1}, len(context)) AS prediction FROM e WHERE pos >= {CONTEXT} AND pos < pos_count - {K}),
kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS vec_id FROM (SELECT DISTINCT event_type FROM events)),
v AS (SELECT event_type, embedding::DOUBLE[] AS x FROM kinds JOIN embeddings USING (vec_id)),
c AS (SELECT a.event_type AS a, b.event_type AS b, least(greatest(1 - list_dot_product(a.x, b.x)
        / (greatest(sqrt(list_dot_product(a.x, a.x)), 1e-10) * greatest(sqrt(list_dot_product(b.x, b.x)), 1e-10)), 0.0), 1.0) AS cost FROM v a, v b)
"""
_COSTED = ", ".join(f"(SELECT cost FROM c WHERE a = ground_truth[{i}] AND b = prediction[{j}]) AS c_{i}_{j}" for i in range(1, K + 1) for j in range(1, K + 1))
_SCORED = f"""s0 AS (SELECT event_id, user_id, pos, {_COSTED} FROM p), s1 AS (SELECT *, {_sql_sed(K, K)} FROM s0),
s AS (SELECT event_id, user_id, pos, d_{K}_{K} AS sed, 1 - d_{K}_{K} / {K} AS raw FROM s1)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    key, order = ["user_id"], ["ts", "event_id"]
    rows = timeline.positions(events(spark, d), key, order)
    rows = timeline.with_context(rows, key, order, "event_type", CONTEXT)
    rows = timeline.with_future(rows, key, order, "event_type", K)
    rows = timeline.eligible(rows, CONTEXT, K)
    return rows.withColumn("prediction", timeline.last_items(F.col("context"), K))


def action_vectors(spark: SparkSession, d: str) -> DataFrame:
    kinds = events(spark, d).select("event_type").distinct().withColumn("vec_id", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))
    return kinds.join(table(spark, d, "embeddings"), "vec_id").select("event_type", "embedding")


def repeat_scores(spark: SparkSession, d: str) -> DataFrame:
    samples = points(spark, d).select("event_id", "user_id", "pos", "ground_truth", "prediction")
    return scoring.score_samples(samples, ["event_id"], "ground_truth", "prediction", action_vectors(spark, d), "event_type", "embedding")


@query(f"WITH {_WINDOWED}, {_SCORED} SELECT event_id, round(sed, 6) AS sed, round(raw, 6) AS raw FROM s")
def sed_repeat_baseline(spark, d):
    return repeat_scores(spark, d).select("event_id", F.round("sed", 6).alias("sed"), F.round("raw", 6).alias("raw"))


@query(
    f"""WITH {_WINDOWED}, {_SCORED}, t AS (SELECT 'b' || (user_id % 2) AS source, 'L' || (pos // 20 + 1) AS level, round(greatest(0.0, (raw - 0.4) / 0.6), 4) AS normalized FROM s)
SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, CASE WHEN grouping(level) = 1 THEN 'ALL' ELSE level END AS level,
  count(normalized) AS n, round(avg(normalized), 4) AS normalized, round(coalesce(stddev_samp(normalized), 0), 4) AS std FROM t GROUP BY CUBE (source, level)"""
)
def cube_summary(spark, d):
    rows = repeat_scores(spark, d).select(F.concat(F.lit("b"), F.col("user_id") % 2).alias("source"), F.concat(F.lit("L"), F.floor(F.col("pos") / 20) + 1).alias("level"), S.normalised(F.col("raw"), F.lit(0.4)).alias("normalized"))
    return scoring.cube_summary(rows, ["source", "level"], "normalized")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return cube_summary(spark, d)


@query(f"WITH {_WINDOWED} SELECT event_id, array_to_string(context, ',') AS context, array_to_string(ground_truth, ',') AS ground_truth, array_to_string(prediction, ',') AS prediction FROM p")
def context_windows(spark, d):
    return points(spark, d).select("event_id", *[F.array_join(c, ",").alias(c) for c in ("context", "ground_truth", "prediction")])


_COS = "list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))"


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM embeddings), a AS (SELECT vec_id // 4 AS sample, vec_id % 4 AS candidate, embedding::DOUBLE[] AS x FROM embeddings),
b AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT a.sample, a.candidate, 1 - least(greatest(1 - {_COS}, 0.0), 1.0) AS raw FROM a, n JOIN b ON b.vec_id = (a.sample * 7 + 3) % n.n)
SELECT sample, candidate, round(raw, 4) AS raw, n AS n_candidates FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(raw, 4) DESC, candidate) AS r, count(*) OVER (PARTITION BY sample) AS n FROM s) WHERE r = 1"""
)
def sed_best_of_n(spark, d):
    v = table(spark, d, "embeddings")
    q = v.select(F.floor(F.col("vec_id") / 4).alias("sample"), (F.col("vec_id") % 4).alias("candidate"), F.col("embedding").alias("x"))
    g = v.select(F.col("vec_id").alias("g"), F.col("embedding").alias("y"))
    s = q.withColumn("g", (F.col("sample") * 7 + 3) % v.count()).join(g, "g").withColumn("raw", 1 - S.scorer_cost(S.cosine(F.col("x"), F.col("y"))))
    return scoring.best_of(s, ["sample"], "raw", "candidate").select("sample", "candidate", F.round("raw", 4).alias("raw"), "n_candidates")


@query(
    f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(least(greatest(1 - c, 0.0), 1.0), 4) AS scorer, round(1 - least(greatest(c, -1.0), 1.0), 4) AS evaluator FROM v a JOIN v b ON a.label = b.label AND a.i // 8 = b.i // 8, LATERAL (SELECT {_COS} AS c)"""
)
def cosine_matrix(spark, d):
    """Cost matrices of all vectors, in samples of eight of one label."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    v = table(spark, d, "embeddings").withColumn("block", F.floor(place / 8))
    a, b = (v.select("label", "block", F.col("vec_id").alias(k), F.col("embedding").alias(f"x{k}")) for k in "ab")
    c = S.cosine(F.col("xa"), F.col("xb"))
    return a.join(b, ["label", "block"]).select("a", "b", F.round(S.scorer_cost(c), 4).alias("scorer"), F.round(S.evaluator_cost(c), 4).alias("evaluator"))


@query("SELECT event_id, event_type AS level, CASE WHEN b IS NULL OR b >= 1 THEN NULL ELSE round(greatest(0.0, (r - b) / (1 - b)), 4) END AS normalized FROM (SELECT event_id, event_type, round(value - floor(value), 6) AS r FROM events) LEFT JOIN (VALUES ('click', 0.4), ('view', 1.0), ('purchase', 0.1)) t(event_type, b) USING (event_type)")
def baseline_normalise(spark, d):
    rows = events(spark, d).select("event_id", F.col("event_type").alias("level"), F.round(F.col("value") - F.floor("value"), 6).alias("raw"))
    base = spark.createDataFrame([("click", 0.4), ("view", 1.0), ("purchase", 0.1)], "level string, random_sed double")
    return scoring.with_baseline(rows, base, ["level"]).select("event_id", "level", "normalized")


@query("SELECT event_id, CASE WHEN s > 9 THEN NULL ELSE s END AS score, round(CASE WHEN s > 9 THEN 1.0 ELSE 1 - s / 9.0 END, 6) AS cost FROM (SELECT event_id, CAST(event_id % 11 AS INT) AS s FROM events)")
def judge_costs(spark, d):
    s = (F.col("event_id") % 11).cast("int")
    rows = events(spark, d).select("event_id", F.when(s <= 9, s).alias("score"))
    return rows.select("event_id", "score", F.round(S.judge_cost(F.col("score")), 6).alias("cost"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(median(value), 4) AS median, min(value) AS low, max(value) AS high, count(*) FILTER (WHERE value < 0.5) AS errors, round(avg(1 - value), 4) AS distance_mean FROM events GROUP BY event_type")
def eval_summary_stats(spark, d):
    return scoring.stats(events(spark, d).withColumn("distance", 1 - F.col("value")), ["event_type"], "value", F.col("value") < 0.5, "distance")


@query("SELECT CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events GROUP BY ROLLUP (event_type)")
def level_rollup(spark, d):
    return scoring.rollup_summary(events(spark, d), "event_type", "value")


@query(
    """WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), s AS (SELECT *, greatest(1, CAST(round_even(500 * n / sum(n) OVER (), 0) AS BIGINT)) AS share FROM g),
t AS (SELECT *, coalesce(sum(share) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY user_id) = count(*) OVER () AS last FROM s)
SELECT user_id, n, CAST(CASE WHEN last THEN greatest(0, 500 - before) ELSE least(share, greatest(0, 500 - before)) END AS BIGINT) AS quota FROM t"""
)
def quota_alloc(spark, d):
    return timeline.allocate(events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), 500, ["user_id"])


@query("SELECT user_id, CAST(500 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY user_id) <= 500 % count(*) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT DISTINCT user_id FROM events)")
def even_split(spark, d):
    return timeline.even_split(events(spark, d).select("user_id").distinct(), 500, ["user_id"])


@query(
    """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM b GROUP BY ALL"""
)
def segments_islands(spark, d):
    return timeline.islands(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", "ts", "ts")


_POS = "q AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


@query(f"WITH {_POS} SELECT p.event_id, coalesce(string_agg(q.event_type, ',' ORDER BY q.pos), '') AS context FROM q p LEFT JOIN q ON q.user_id = p.user_id AND q.pos <= p.pos AND q.pos > p.pos - 50 GROUP BY p.event_id")
def fill_backward_cross_session(spark, d):
    e = timeline.positions(events(spark, d), ["user_id"], ["ts", "event_id"]).drop("pos_count")
    p = e.select("event_id", "user_id", F.col("pos").alias("end_pos"))
    return timeline.backward_fill(p, e, ["user_id"], 50, "event_type").select("event_id", F.array_join("context", ",").alias("context"))


@query(f"WITH {_POS} SELECT p.event_id, coalesce(string_agg(q.event_type, ',' ORDER BY q.pos), '') AS ground_truth FROM q p LEFT JOIN q ON q.user_id = p.user_id AND q.pos > p.pos AND q.pos <= p.pos + 10 GROUP BY p.event_id")
def gt_extend_forward(spark, d):
    e = timeline.positions(events(spark, d), ["user_id"], ["ts", "event_id"]).drop("pos_count")
    p = e.select("event_id", "user_id", F.col("pos").alias("start_pos"))
    return timeline.forward_fill(p, e, ["user_id"], 10, "event_type").select("event_id", F.array_join("ground_truth", ",").alias("ground_truth"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_id), event_id) AS r FROM events) WHERE r <= 20")
def stratified_sample(spark, d):
    return timeline.hashed_sample(events(spark, d), ["event_type"], "event_id", 20).select("event_type", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE i % greatest(1, c // 8) = 0 AND i // greatest(1, c // 8) < 8")
def even_step_sample(spark, d):
    return timeline.even_step(events(spark, d), ["user_id"], ["ts", "event_id"], 8).select("user_id", "event_id")


@query("SELECT event_id, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts + INTERVAL 1 SECOND) AS until FROM events")
def hold_until_next(spark, d):
    return timeline.hold_until_next(events(spark, d), ["user_id"], ["ts", "event_id"], "ts", F.expr("ts + INTERVAL 1 SECOND")).select("event_id", "until")


@query("SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), ',') AS trail FROM events WHERE value >= 1")
def trail_last6(spark, d):
    return timeline.trail(events(spark, d), ["user_id"], ["ts", "event_id"], F.col("value") >= 1, "event_id").select("event_id", F.array_join(F.transform("trail", lambda x: x.cast("string")), ",").alias("trail"))


@query("SELECT user_id, CAST(event_id // 30 AS BIGINT) AS clip, count(*) AS n, min_by(event_type, event_id) AS first FROM events GROUP BY ALL")
def clip_bucket(spark, d):
    return events(spark, d).groupBy("user_id", captions.tumbling(F.col("event_id"), 30).alias("clip")).agg(F.count(F.lit(1)).alias("n"), F.min_by("event_type", "event_id").alias("first"))


_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(f"WITH e AS (SELECT event_id, user_id, event_type, {_SECONDS} AS s FROM events) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.s < b.s + 7200 AND a.s + 3600 > b.s AND a.event_type = 'click' AND b.event_type = 'purchase'")
def interval_overlap_join(spark, d):
    e = events(spark, d).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp_ltz")))
    a = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("a"), F.col("s").alias("a0"), (F.col("s") + 3600).alias("a1"))
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), F.col("s").alias("b0"), (F.col("s") + 7200).alias("b1"))
    return joins.overlap(a, b, ["user_id"], ("a0", "a1"), ("b0", "b1"), 3600).select("a", "b")


@query(f"WITH e AS (SELECT event_id, user_id, event_type, {_SECONDS} AS s FROM events), p AS (SELECT * FROM e WHERE event_type = 'click'), m AS (SELECT * FROM e WHERE event_type = 'purchase') SELECT p.event_id, min_by(m.event_id, m.s * 1000000 + m.event_id) AS span FROM p LEFT JOIN m ON p.user_id = m.user_id AND m.s <= p.s AND p.s < m.s + 86400 GROUP BY p.event_id")
def point_in_interval(spark, d):
    e = events(spark, d).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp_ltz")))
    p = e.filter("event_type = 'click'").select("user_id", "event_id", "s")
    m = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span"), F.col("s").alias("s0"), (F.col("s") + 86400).alias("s1"), (F.col("s") * 1000000 + F.col("event_id")).alias("o"))
    return joins.containing(p, m, ["user_id"], "s", ("s0", "s1"), "o", 86400).select("event_id", "span")


@query(f"WITH e AS (SELECT event_id, user_id, event_type, {_SECONDS} AS s FROM events), p AS (SELECT * FROM e WHERE event_type = 'click'), m AS (SELECT * FROM e WHERE event_type = 'purchase') SELECT event_id, gap FROM (SELECT p.event_id, abs(p.s - m.s) AS gap, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.s - m.s), m.s) AS r FROM p LEFT JOIN m ON p.user_id = m.user_id) WHERE r = 1")
def nearest_event_asof(spark, d):
    e = events(spark, d).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp_ltz")))
    m = e.filter("event_type = 'purchase'").select("user_id", F.col("s").alias("ms"), F.col("s").alias("at"))
    found = joins.nearest(e.filter("event_type = 'click'").select("user_id", "event_id", "s"), m, ["user_id"], "s", "ms", "at")
    return found.select("event_id", F.abs(F.col("s") - F.col("at")).alias("gap"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return joins.resume(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_kept(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text")
def order_distinct_texts(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("first_id"))


@query("SELECT source, lang, min_by(doc_id, n_chars * 1000000 + doc_id) AS first FROM documents GROUP BY source, lang")
def pair_first_context(spark, d):
    rows = table(spark, d, "documents").withColumn("place", F.col("n_chars") * 1000000 + F.col("doc_id"))
    return joins.pair_distinct(rows, ["source", "lang"], "doc_id", "place").withColumnRenamed("doc_id", "first")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_ok, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_failed, round(sum(o_totalprice), 2) AS spent, min_by(o_orderpriority, o_orderkey) AS first, max_by(o_orderpriority, o_orderkey) AS last FROM orders GROUP BY o_custkey")
def merge_rollup(spark, d):
    rows = table(spark, d, "orders").withColumn("ok", F.col("o_orderstatus") != "F")
    out = captions.recording_rollup(rows, ["o_custkey"], "o_orderkey", "ok", "o_orderpriority", "o_orderpriority", ["o_totalprice"])
    return out.select("o_custkey", "n_ok", "n_failed", F.round("o_totalprice", 2).alias("spent"), "first", "last")


@query("SELECT l_orderkey, l_linenumber, round(l_partkey / 1e6 * 0.75 + (l_suppkey + l_linenumber) / 1e6 * 3.75, 9) AS cost FROM lineitem")
def token_cost(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", captions.cost(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), 9).alias("cost"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT o_custkey) AS recordings, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1")
def day_rollup(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("recordings"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


@query("SELECT source, count(*) FILTER (WHERE quality = 1) AS usable_clips, count(*) AS target_clips, round(count(*) FILTER (WHERE quality = 1) / count(*), 3) AS coverage, CAST(sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END) AS BIGINT) AS minutes, count(*) FILTER (WHERE quality = 1 AND doc_id < 500) AS in_first FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def coverage_index(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return captions.delivery_index(rows, ["source"], F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("n_chars"), F.col("doc_id") < 500)


@query("SELECT source, string_agg(lang || ':' || n, ',' ORDER BY lang) AS models FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def model_counts(spark, d):
    rows = captions.value_counts(table(spark, d, "documents"), ["source"], "lang")
    return rows.select("source", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("models"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversation_concat(spark, d):
    return captions.ordered_text(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.concat_ws(": ", "role", "text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT l_returnflag, n, l_extendedprice AS p FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE i = least(CAST(floor(n * 0.9) AS BIGINT), n - 1)")
def p90_index(spark, d):
    return scoring.nearest_rank(["l_returnflag"], table(spark, d, "lineitem"), "l_extendedprice")


@query("SELECT l_shipdate_month, n, per_s, parallelism, median_s, tokens_per_min FROM (SELECT month(l_shipdate) AS l_shipdate_month, count(*) AS n, round(count(*) / max(l_quantity), 4) AS per_s, round(sum(l_discount) / max(l_quantity), 4) AS parallelism, round(median(l_discount), 4) AS median_s, round(sum(l_partkey) * 60 / max(l_quantity), 2) AS tokens_per_min FROM lineitem GROUP BY 1)")
def throughput(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_shipdate_month", F.month("l_shipdate").cast("long"))
    return scoring.throughput(rows, ["l_shipdate_month"], "l_discount", "l_quantity", "l_partkey")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_top1(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1").select("user_id", "event_id", "event_type")


_SAFE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", redact.MASK), ("url", r"https?://[^ \n\t\"<>]+", redact.MASK), ("digits", r"[0-9]{11,}", redact.MASK)]


def _sql_counts(column: str) -> list[str]:
    out, now = [], column
    for name, pattern, new in _SAFE:
        quoted = pattern.replace("'", "''")
        out.append(f"len(regexp_extract_all({now}, '{quoted}')) AS n_{name}")
        now = f"regexp_replace({now}, '{quoted}', '{new}', 'g')"
    return [*out, f"{now} AS text"]


@query(f"SELECT doc_id, {', '.join(_sql_counts('text'))} FROM documents")
def mask_email_url(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    for name, pattern, new in _SAFE:
        rows = rows.withColumn(f"n_{name}", F.regexp_count("text", F.lit(pattern)).cast("long")).withColumn("text", F.regexp_replace("text", pattern, new))
    return rows.select("doc_id", *[f"n_{name}" for name, _, _ in _SAFE], "text")


@query()
def mask_delivery(spark, d):
    rows = redact.masked(table(spark, d, "documents").select("doc_id", "source", "text"), "text")
    return rows.select("doc_id", F.sha1("text").alias("text_sha1"), F.aggregate("hits", F.lit(0), lambda a, h: a + h["n"]).alias("n"))


@query()
def redaction_audit(spark, d):
    return redact.audit(redact.masked(table(spark, d, "documents").select("doc_id", "source", "text"), "text"), "source", "doc_id")


@query()
def placeholder_audit(spark, d):
    rows = redact.masked(table(spark, d, "documents").select("doc_id", "source", "text"), "text", redact.placeholder_rules(base.INSTITUTIONS))
    return redact.audit(rows, "source", "doc_id")


@query("SELECT source, doc_id, substr(sha256(source || ':' || doc_id), 1, 16) AS location FROM documents")
def location_hash_audit(spark, d):
    return table(spark, d, "documents").select("source", "doc_id", redact.location_hash(F.col("source"), F.col("doc_id")).alias("location"))


@query()
def person_name_masks(spark, d):
    rows = redact.with_person_names(table(spark, d, "conversations"), "text", True)
    return rows.select("conv_id", "turn", F.size("names").alias("n_names"), F.sha1(redact.mask_names(F.col("text"), F.col("names"))).alias("masked_sha1"))


@query("SELECT event_id, event_type AS text FROM (SELECT event_id, '[10:00:0' || (event_id % 10) || ' -> 10:01:00] ' || event_type AS line, event_type FROM events)")
def strip_timestamps(spark, d):
    line = F.concat(F.lit("[10:00:0"), (F.col("event_id") % 10).cast("string"), F.lit(" -> 10:01:00] "), F.col("event_type"))
    return events(spark, d).select("event_id", X.strip_timestamps(line).alias("text"))


@query("SELECT event_id, (event_id % 10) AS s0, (event_id % 10) + 5 AS s1 FROM events")
def segment_spans(spark, d):
    c = F.concat(F.lit("00:00:0"), (F.col("event_id") % 10).cast("string"), F.lit(" – 00:00:"), F.lpad((F.col("event_id") % 10 + 5).cast("string"), 2, "0"))
    span = X.segment_span(c)
    return events(spark, d).select("event_id", span["start"].cast("long").alias("s0"), span["end"].cast("long").alias("s1"))


@query("SELECT conv_id, count(*) AS n, array_to_string(list(DISTINCT role ORDER BY role), ',') AS roles FROM conversations GROUP BY conv_id")
def set_union_roles(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("SELECT kind, count(*) AS n, max(id) AS last, count(value) AS valued FROM (SELECT event_type AS kind, event_id AS id, value FROM events UNION ALL SELECT o_orderstatus, o_orderkey, NULL FROM orders) GROUP BY kind")
def union_all_sources(spark, d):
    one = events(spark, d).select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "value")
    two = table(spark, d, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("id"))
    return one.unionByName(two, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"), F.count("value").alias("valued"))


@query("SELECT user_id, count(*) AS clips, count(*) FILTER (WHERE value >= 1) AS ok, round(sum(value), 4) AS cost FROM events GROUP BY user_id")
def incremental_totals(spark, d):
    from strandline.streaming import incremental

    e = events(spark, d)
    twice = e.unionByName(e)  # every clip comes in two files
    out = incremental.totals(twice, ["user_id", "event_id"], ["user_id"], F.col("value"), F.col("value") >= 1)
    return out.withColumn("cost", F.round("cost", 4))
