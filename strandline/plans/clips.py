"""Queries of clips, merges, deliveries and their joins. Orders are clips of a customer's recording, line items their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import captions, delivery, joins, merge
from strandline.plans.base import events, query, table
from strandline.sources import files

def _id() -> Column:
    return F.col("event_id")


def _text(c: Column) -> Column:
    return c.cast("string")


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Orders as clips: of half a minute each, failed where the order is 'F', with their line items as segments."""
    items = table(spark, d, "lineitem")
    clock = F.concat(F.lit("10:0"), _text(F.col("l_linenumber") % 10), F.lit(":00"))
    segment = F.struct(
        F.concat(clock, F.lit("–10:30:00")).alias("time_range"), F.concat(F.lit("part "), _text(F.col("l_partkey"))).alias("action"), F.col("l_linestatus").alias("environment"),
        F.when(F.col("l_returnflag") == "A", "said A").alias("speech"), F.array("l_returnflag").alias("text_visible"), F.array().cast("array<string>").alias("objects"), F.lit("").alias("details"),
    )
    found = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", segment.alias("s")))), lambda x: x["s"]).alias("segments"), F.sum("l_suppkey").alias("tokens"))
    o = table(spark, d, "orders").join(found, "o_orderkey", "left")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    parsed = F.struct(F.col("o_orderpriority").alias("scene_summary"), F.lit("").alias("activity_chain"), F.coalesce("segments", F.array().cast(o.schema["segments"].dataType)).alias("segments"))
    return o.select(
        F.concat(F.lit("r"), _text(F.col("o_custkey"))).alias("recording"), F.col("o_orderkey").alias("clip_id"), (F.col("o_orderstatus") != "F").alias("ok"),
        F.concat(day, F.lit(" 10:00:00")).alias("clip_start"), F.concat(day, F.lit(" 10:00:30")).alias("clip_end"), (F.col("o_custkey") % 2 == 0).alias("has_gaze"), F.col("o_orderpriority").alias("model"),
        F.col("tokens").alias("tokens_in"), F.lit(10).alias("tokens_out"), F.lit(None).cast("int").alias("tokens_think"), parsed.alias("parsed"),
    )


_MERGED = """WITH i AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, sum(l_suppkey) AS tokens FROM lineitem GROUP BY 1),
m AS (SELECT 'r' || o_custkey AS recording, min_by(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS date, count(*) AS clip_count, count(*) FILTER (WHERE o_orderstatus <> 'F') AS clip_ok, count(*) FILTER (WHERE o_orderstatus = 'F') AS clip_failed,
 CAST(sum(coalesce(n, 0)) AS BIGINT) AS segment_count, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens_in, 10 * count(*) AS tokens_out, min_by(o_orderpriority, o_orderkey) AS model, o_custkey % 2 = 0 AS has_gaze
 FROM orders LEFT JOIN i USING (o_orderkey) GROUP BY o_custkey)"""


@query(f"{_MERGED} SELECT recording, date, clip_count, clip_ok, clip_failed, segment_count, tokens_in, tokens_out, round(tokens_in / 1e6 * 0.75 + tokens_out / 1e6 * 3.75, 4) AS est_cost_usd, model, has_gaze FROM m")
def merged_recordings(spark, d):
    m = merge.merged_recordings(_clips(spark, d))
    return m.select("recording", "date", "clip_count", "clip_ok", "clip_failed", F.col("segment_count").cast("long").alias("segment_count"), F.col("tokens.in").alias("tokens_in"), F.col("tokens.out_billable").alias("tokens_out"), "est_cost_usd", "model", "has_gaze")


@query(f"{_MERGED} SELECT date, count(*) AS recording_count, CAST(sum(segment_count) AS BIGINT) AS segment_count, CAST(sum(clip_ok) AS BIGINT) AS clip_ok, CAST(sum(clip_count) AS BIGINT) AS clip_count FROM m GROUP BY date")
def merged_days(spark, d):
    days = merge.merged_days(merge.merged_recordings(_clips(spark, d)))
    return days.select("date", F.col("recording_count").cast("long").alias("recording_count"), F.col("segment_count").cast("long").alias("segment_count"), "clip_ok", "clip_count")


@query(
    """WITH s AS (SELECT *, '   [10:0' || l_linenumber % 10 || ':00–10:30:00] part ' || l_partkey || CASE WHEN l_returnflag = 'A' THEN chr(10) || '       语音: said A' ELSE '' END || chr(10) || '       环境: ' || l_linestatus || chr(10) || '       文字: ' || l_returnflag AS line FROM lineitem),
c AS (SELECT o_custkey, o_orderkey, '── clip_' || CASE WHEN o_orderkey < 10000 THEN printf('%04d', o_orderkey) ELSE substr(CAST(o_orderkey AS VARCHAR), 1, 4) END || '  10:00:00–10:00:30  ' || CASE WHEN o_orderstatus = 'F' THEN '[FAILED]' ELSE '' END || chr(10) || '   « ' || o_orderpriority || ' »' || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, 'part ' || l_partkey, l_linestatus, l_returnflag = 'A', l_returnflag), '') || chr(10) AS block
 FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderstatus, o_orderpriority)
SELECT 'r' || o_custkey AS recording, md5(string_agg(block, chr(10) ORDER BY o_orderkey)) AS body FROM c WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderkey) < 10000) GROUP BY o_custkey"""
)
def recording_texts(spark, d):
    """Readable form of recordings, without its three head lines."""
    clips = _clips(spark, d)
    short = clips.groupBy("recording").agg(F.max("clip_id").alias("last")).filter("last < 10000")  # longer numbers are cut at four digits
    text = merge.recording_text(merge.merged_recordings(clips.join(short, "recording", "left_semi")))
    return text.select("recording", F.md5(F.regexp_replace("text", r"^(?:[^\n]*\n){4}", "")).alias("body"))


@query(
    """WITH b AS (SELECT 'r' || o_custkey AS recording, string_agg(l_comment_like, ' ' ORDER BY l_orderkey, l_linenumber) AS blob FROM (SELECT o_custkey, l_orderkey, l_linenumber, 'User ' || l_returnflag || ' a' || l_partkey || '@x.org' AS l_comment_like FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1)
SELECT recording, len(regexp_extract_all(blob, '@x[.]org')) AS email_plain, len(regexp_extract_all(blob, 'User [A-Z]')) AS anonymized_placeholders FROM b"""
)
def merge_audits(spark, d):
    i, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    line = F.concat(F.lit("User "), "l_returnflag", F.lit(" a"), _text(F.col("l_partkey")), F.lit("@x.org"))
    rows = i.join(o, i.l_orderkey == o.o_orderkey).select(F.concat(F.lit("r"), _text(F.col("o_custkey"))).alias("recording"), "l_orderkey", "l_linenumber", line.alias("line"))
    blobs = captions.ordered_text(rows, ["recording"], ["l_orderkey", "l_linenumber"], F.col("line"), " ")
    return merge.pii_audit(blobs, ["recording"], "text", r"\bexample school\b").select("recording", "email_plain", "anonymized_placeholders")


@query("SELECT 'r' || o_custkey AS recording, row_number() OVER (PARTITION BY o_custkey ORDER BY '10:0' || l_linenumber % 10 || ':00', l_orderkey, l_linenumber, 'part ' || l_partkey, l_linestatus, l_returnflag = 'A', l_returnflag) - 1 AS line_no, '[10:0' || l_linenumber % 10 || ':00 -> 10:30:00] part ' || l_partkey AS line FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'")
def converted_events(spark, d):
    """Event lines of the segments of clips that are ok, by start string."""
    clips = _clips(spark, d).filter(captions.ok_truthy(F.col("ok"))).select("recording", "clip_id", F.col("parsed.segments").alias("segments"))
    return captions.event_lines(captions.segments(clips, ["recording", "clip_id"], "segments"), ["recording"], ["clip_id", "segment_no"])


@query("SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber), '') AS numbers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def clip_segments_join(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    rows = joins.segments_by_clip(table(spark, d, "orders").select("o_orderkey"), found, "o_orderkey", ["l_linenumber"])
    return rows.select("o_orderkey", F.size("segments").cast("long").alias("n"), F.array_join(F.transform("segments", lambda s: _text(s["l_linenumber"])), ",").alias("numbers"))


_SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


@query(
    f"""WITH e AS (SELECT event_id, user_id, event_type, {_SECONDS} AS s FROM events), p AS (SELECT * FROM e WHERE event_type = 'click'), m AS (SELECT * FROM e WHERE event_type = 'purchase'),
h AS (SELECT p.event_id, min(m.s) AS held FROM p JOIN m ON p.user_id = m.user_id AND m.s <= p.s AND p.s < m.s + 7200 GROUP BY 1),
n AS (SELECT event_id, near FROM (SELECT p.event_id, m.s AS near, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.s - m.s), m.s) AS r FROM p LEFT JOIN m ON p.user_id = m.user_id) WHERE r = 1)
SELECT event_id, coalesce(held, near) AS start FROM n LEFT JOIN h USING (event_id)"""
)
def held_or_nearest_segment(spark, d):
    e = events(spark, d).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp_ltz")))
    m = e.filter("event_type = 'purchase'").select("user_id", F.col("s").alias("s0"), (F.col("s") + 7200).alias("s1"), F.col("s").alias("start"))
    return joins.containing_or_nearest(e.filter("event_type = 'click'").select("user_id", "event_id", "s"), m, ["user_id"], "s", ("s0", "s1"), "start", 86400).select("event_id", "start")


@query("WITH f AS (SELECT conv_id, role, min(turn) AS frame FROM conversations GROUP BY ALL) SELECT conv_id, role, (SELECT min_by(c.text, c.turn) FROM conversations c WHERE c.conv_id = f.conv_id AND contains(c.role || ': ' || c.text, f.role)) AS text FROM f")
def frame_text_by_substring(spark, d):
    c = table(spark, d, "conversations")
    frames = c.groupBy("conv_id", "role").agg(F.min("turn").alias("frame")).select("conv_id", "role")
    texts = c.select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("shown"), "text")
    found = joins.first_containing_text(frames, texts.select("conv_id", "turn", "shown"), ["conv_id"], "role", "shown", "turn")
    return found.select("conv_id", "role", F.regexp_replace("shown", r"(?s)^[^:]*: ", "").alias("text"))


@query("SELECT c.conv_id, c.turn, e.value FROM conversations c LEFT JOIN (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS turn, value FROM events) e ON e.user_id = c.conv_id AND e.turn = c.turn")
def frame_readings(spark, d):
    from pyspark.sql import Window

    frames = table(spark, d, "conversations").select("conv_id", "turn")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    gaze = events(spark, d).select(F.col("user_id").alias("conv_id"), place.cast("long").alias("turn"), "value")
    return joins.by_frame(frames, gaze, ["conv_id"], "turn")


@query(
    """WITH a AS (SELECT DISTINCT 'u' || user_id AS a FROM events), b AS (SELECT DISTINCT 'u' || user_id % 20 || CASE WHEN user_id % 3 = 0 THEN '5' ELSE '' END AS b FROM events)
SELECT a, b FROM a JOIN b ON starts_with(a, substr(b, 1, 3)) OR starts_with(b, substr(a, 1, 3))"""
)
def names_by_either_prefix(spark, d):
    e = events(spark, d)
    a = e.select(F.concat(F.lit("u"), _text(F.col("user_id"))).alias("a")).distinct()
    b = e.select(F.concat(F.lit("u"), _text(F.col("user_id") % 20), F.when(F.col("user_id") % 3 == 0, "5").otherwise("")).alias("b")).distinct()
    return joins.by_prefix(a, b, "a", "b", 3, "inner")


@query("SELECT o_orderkey, count(l_orderkey) > 0 AS answered, max(l_partkey) AS answer FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def batch_responses(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("answer"))
    rows = joins.responses(table(spark, d, "orders").select("o_orderkey"), found, "o_orderkey", "answer", "answer")
    return rows.select("o_orderkey", F.col("answer").isNotNull().alias("answered"), "answer")


@query(
    """WITH i AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS speech, sum(length('part ' || l_partkey) + length(l_linestatus)) AS chars, sum(l_suppkey) AS tokens FROM lineitem GROUP BY 1),
c AS (SELECT o_orderpriority AS model, coalesce(n, 0) AS n, coalesce(speech, 0) AS speech, coalesce(chars, 0) AS chars, coalesce(tokens, 0) AS tokens, o_orderkey % 50 AS s FROM orders LEFT JOIN i ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F')
SELECT model, count(*) AS clips, round(sum(n) / count(*), 1) AS n_segments, round(sum(speech) / count(*), 1) AS speech, round(sum(n) / count(*), 1) AS text_items, round(0 / count(*), 1) AS objects, round(sum(chars) / count(*), 1) AS chars,
 CAST(sum(tokens) // count(*) AS BIGINT) AS tokens_in, CAST(10 AS BIGINT) AS tokens_out, round(sum(s) / count(*), 1) AS seconds, round(sum(tokens) / count(*) / 1e6 * CASE WHEN model = '1-URGENT' THEN 2.0 ELSE 0.75 END + 10.0 / 1e6 * CASE WHEN model = '1-URGENT' THEN 4.0 ELSE 3.75 END, 4) AS cost_per_clip FROM c GROUP BY model"""
)
def model_comparison(spark, d):
    clips = _clips(spark, d).select("model", "ok", F.col("parsed.segments").alias("segments"), "tokens_in", "tokens_out", (F.col("clip_id") % 50).alias("seconds"))
    return captions.model_comparison(clips, spark.createDataFrame([("1-URGENT", 2.0, 4.0)], "model string, price_in double, price_out double"))


@query(
    """WITH r AS (SELECT (user_id % 6 + 1) || '-' || (user_id % 28 + 1) || '_hkt0900-1000_60m_' || user_id AS recording, user_id, sum(value) AS usd, count(*) AS clips, count(*) FILTER (WHERE value >= 1) AS ok FROM events GROUP BY user_id)
SELECT CASE WHEN user_id IN (3, 7) OR user_id % 6 + 1 >= 5 THEN 'B' ELSE 'A' END AS wave, round(sum(usd), 4) AS usd, CAST(sum(clips) AS BIGINT) AS clips, CAST(sum(ok) AS BIGINT) AS ok FROM r GROUP BY 1"""
)
def cost_by_wave(spark, d):
    u = F.col("user_id")
    place = lambda n: _text(F.greatest(u % n + 1, F.lit(0)))  # noqa: E731  # users below 0 or unknown are of no late month, as in the SQL
    name = F.concat(place(6), F.lit("-"), place(28), F.lit("_hkt0900-1000_60m_"), F.coalesce(_text(u), F.lit("")))
    totals = events(spark, d).groupBy("user_id").agg(F.sum("value").alias("usd"), F.count(F.lit(1)).alias("clips"), F.count_if(F.col("value") >= 1).alias("ok")).withColumn("recording", name)
    moved = ["4-4_hkt0900-1000_60m_3", "2-8_hkt0900-1000_60m_7"]
    return captions.cost_by_wave(totals, moved, "2026-05-01", 2026, 40).withColumn("usd", F.round("usd", 4))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def state_counts(spark, d):
    return captions.counts_by(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT conv_id AS scene, string_agg(role, ',' ORDER BY turn) AS models FROM conversations WHERE turn % 3 <> 2 GROUP BY conv_id")
def models_by_scene(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("scene"), "turn", F.col("role").alias("model"), F.when(F.col("turn") % 3 == 2, "failed").alias("error"))
    return captions.models_by_scene(rows, "turn").select("scene", F.array_join("models", ",").alias("models"))


@query(
    """WITH c AS (SELECT user_id, event_id, event_id % 40 AS s, CASE WHEN event_id % 3 = 0 THEN 'screen' ELSE event_type END AS label FROM events WHERE event_id % 5 <> 4),
g AS (SELECT user_id, s, list(label ORDER BY event_id) AS labels, string_agg('[' || label || '] ' || event_id || '|t', '|' ORDER BY event_id) AS shown FROM c GROUP BY ALL)
SELECT user_id, printf('10:00:%02d', s) AS start, CASE WHEN lead(s) OVER w IS NOT NULL THEN printf('10:00:%02d', lead(s) OVER w) WHEN s < 30 THEN '10:00:30' ELSE printf('10:00:%02d', s + 1) END AS "end", shown FROM g WINDOW w AS (PARTITION BY user_id ORDER BY s)"""
)
def screen_readings(spark, d):
    stamp = F.when(_id() % 5 == 4, "soon").otherwise(F.concat(F.lit(" 10:00:"), F.lpad(_text(_id() % 40), 2, "0")))
    crops = events(spark, d).select("user_id", "event_id", stamp.alias("hkt"), F.when(_id() % 3 != 0, F.col("event_type")).alias("label"), _text(_id()).alias("summary"), F.array(F.lit("t")).alias("text"), F.lit("2026-04-15 10:00:30").alias("clip_end"))
    return captions.readings(crops, ["user_id"], "event_id", "clip_end").select("user_id", "start", "end", F.array_join("text_visible", "|").alias("shown"))


@query("SELECT (SELECT count(*) FROM labels) || '/' || (SELECT count(*) FROM documents) AS coverage, (SELECT count(*) FROM labels) AS ok, (SELECT count(*) FROM documents) AS total")
def scored_coverage(spark, d):
    return captions.coverage(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id")


@query(
    """WITH r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS i, 'scene_' || conv_id AS scene, role AS model, text AS content FROM conversations), w AS (SELECT DISTINCT 'scene_' || conv_id || CASE WHEN conv_id % 2 = 0 THEN '_x' ELSE '' END AS scene, CASE WHEN conv_id % 3 = 0 THEN 'user' WHEN conv_id % 3 = 1 THEN 'none' END AS hint FROM conversations),
p AS (SELECT w.scene, w.hint, r.i, r.content, CASE WHEN r.i IS NULL THEN 0 WHEN coalesce(w.hint, '') = '' OR contains(r.model, w.hint) THEN 2 ELSE 1 END AS fit FROM w LEFT JOIN r ON contains(r.scene, w.scene) OR contains(w.scene, r.scene))
SELECT scene, hint, md5(coalesce(content, (SELECT content FROM r WHERE i = 1))) AS content FROM (SELECT *, row_number() OVER (PARTITION BY scene, hint ORDER BY fit DESC, i) AS k FROM p) WHERE k = 1"""
)
def best_result_match(spark, d):
    c = table(spark, d, "conversations")
    scene = F.concat(F.lit("scene_"), _text(F.col("conv_id")))
    place = F.struct(*[x for k in ("conv_id", "turn") for x in (F.col(k).isNull(), F.col(k))])  # nulls last, as in the SQL
    r = c.select(place.alias("i"), scene.alias("scene"), F.col("role").alias("model"), F.col("text").alias("content"))
    hint = F.when(F.col("conv_id") % 3 == 0, "user").when(F.col("conv_id") % 3 == 1, "none")
    w = c.select(F.concat(scene, F.when(F.col("conv_id") % 2 == 0, "_x").otherwise("")).alias("scene"), hint.alias("hint")).distinct()
    return captions.best_match(w, r, "i").select("scene", "hint", F.md5("content").alias("content"))


@query("SELECT o_orderkey AS scene FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def shown_scenes(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("scene"), (F.col("o_orderstatus") != "F").alias("pass1_ok"), F.when(F.col("o_orderpriority") != "5-LOW", "caption").alias("merged"), F.col("o_orderkey").alias("at"))
    other = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("scene"))
    return captions.shown_scenes(rows, "at", other).select("scene")


@query("SELECT c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001') ORDER BY c_name DESC LIMIT 1")
def latest_results_file(spark, d):
    return captions.latest_file(table(spark, d, "customer").select("c_name"), "c_name", ["v9_", "Customer#0000001", "Customer#"])


@query("SELECT source, doc_id FROM (SELECT source, doc_id, text, length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS n, max(coalesce(text, '') <> '') OVER (PARTITION BY source) AS any_text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM (SELECT source, doc_id, CASE WHEN source LIKE '%1%' THEN NULL ELSE substr(text, 1, doc_id % 90) END AS text FROM documents)) WHERE n >= 40 OR (NOT any_text AND r <= 4)")
def dense_frames(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.when(~F.col("source").contains("1"), F.substring(F.col("text"), F.lit(1), (F.col("doc_id") % 90).cast("int"))).alias("text"))
    return captions.dense_frames(docs, ["source"], "doc_id", "text").select("source", "doc_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE i % 7 = 0 AND user_id NOT IN (3, 5)")
def strided_frames(spark, d):
    rows = events(spark, d).filter(~F.col("user_id").isin(3, 5))
    return captions.strided(rows, ["user_id"], "event_id", 7).select("user_id", "event_id")


@query("SELECT event_id, CAST('{\"key\":\"' || event_id || '\",\"request\":{\"prompt\":\"' || event_type || '\"}}' AS VARCHAR) AS value FROM events")
def batch_request_lines(spark, d):
    rows = files.batch_requests(events(spark, d).select("event_id", "event_type"), "event_id", "event_type")
    return rows.select(F.get_json_object("value", "$.key").cast("long").alias("event_id"), "value")


def delivery_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as a delivery: a recording per conversation, a record and a text block per turn, and their index."""
    c = table(spark, d, "conversations")
    record = F.struct(
        (F.col("turn") % 4 != 3).alias("ok"), F.col("turn").alias("clip_id"), F.col("role").alias("model"), F.lit("raw").alias("content_raw"),
        F.struct(F.array(F.struct(F.col("text").alias("speech"), F.lit("Sam").alias("speaker"))).alias("segments")).alias("merged"),
    )
    line = F.when(F.col("turn") == 6, "{broken").otherwise(F.to_json(record))
    recording = F.concat(F.lit("rec"), _text(F.col("conv_id"))).alias("recording")
    records = c.select(recording, F.concat(F.lit("rec"), _text(F.col("conv_id")), F.lit("/captions.jsonl")).alias("rel"), (F.col("turn") + 1).alias("line_no"), line.alias("line"))
    block = F.array(F.concat(F.lit("===== clip "), _text(F.col("turn")), F.lit("  =====")), F.regexp_replace("text", r"\s+", " "), F.lit(""))
    texts = c.select(recording, F.concat(F.lit("rec"), _text(F.col("conv_id")), F.lit("/captions.txt")).alias("rel"), "turn", F.posexplode(block).alias("i", "line"))
    texts = texts.select("recording", "rel", (F.col("turn") * 3 + F.col("i") + 1).alias("line_no"), "line")
    index = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(recording, F.col("n").alias("usable_clips"), (F.col("n") + 2).alias("target_clips"), (F.col("conv_id") % 2 == 0).alias("in_first_100h"))
    return records, texts, index


_STATS = "s AS (SELECT conv_id, max(turn) + 1 AS lines, count(*) FILTER (WHERE turn % 4 <> 3 AND turn <> 6) AS kept, count(*) FILTER (WHERE turn % 4 = 3) AS failed, count(*) FILTER (WHERE turn = 6) AS bad, count(*) + 2 AS target FROM conversations GROUP BY conv_id)"


@query(f"WITH {_STATS} SELECT 'rec' || conv_id AS recording, kept AS usable_clips, lines AS target_clips, target AS source_planned_target_clips, CASE WHEN lines > 0 THEN round(kept / lines, 3) END AS coverage, kept AS segments, failed AS filtered_failed, bad AS parse_errors FROM s")
def delivery_index(spark, d):
    records, _, index = delivery_inputs(spark, d)
    stats = delivery.record_stats(delivery.read_records(records))
    rows = delivery.recomputed_index(index, stats).drop("models", "in_first_100h", "selected_candidate_clips")
    return rows.withColumn("segments", F.col("segments").cast("long")).join(stats.select("recording", "filtered_failed", "parse_errors"), "recording")


@query(
    f"""WITH {_STATS} SELECT CAST(sum(kept) AS BIGINT) AS usable_clips_total, CAST(sum(lines) AS BIGINT) AS selected_candidate_clips_total, CAST(sum(kept) FILTER (WHERE conv_id % 2 = 0) AS BIGINT) AS first_100h_usable, CAST(sum(lines) FILTER (WHERE conv_id % 2 = 0) AS BIGINT) AS first_100h_target,
CAST(sum(target) FILTER (WHERE conv_id % 2 = 0) AS BIGINT) AS source_planned_target_clips, count(*) FILTER (WHERE kept > 0) AS recordings_with_output, round(sum(kept) / sum(lines), 3) AS selected_candidate_coverage, CAST(sum(lines) - sum(kept) AS BIGINT) AS filtered_or_unparseable_clips_total,
round(sum(kept) FILTER (WHERE conv_id % 2 = 0) / sum(lines) FILTER (WHERE conv_id % 2 = 0), 3) AS first_100h_coverage FROM s"""
)
def delivery_summary(spark, d):
    records, _, index = delivery_inputs(spark, d)
    return delivery.index_summary(delivery.recomputed_index(index, delivery.record_stats(delivery.read_records(records))))


@query(f"WITH {_STATS} SELECT 'rec' || conv_id AS recording, kept AS usable_clips, target AS target_clips, kept AS segments, failed AS filtered_failed_clips, round(kept / target, 3) AS coverage, conv_id % 2 = 0 AS in_first_100h FROM s")
def archived_delivery_index(spark, d):
    records, _, index = delivery_inputs(spark, d)
    return delivery.archived_index(index, delivery.record_stats(delivery.read_records(records)))


@query("SELECT 'rec' || conv_id AS recording, turn + 1 AS line_no, 'XXX' AS content_raw, 'XXX' AS speaker, role AS model FROM conversations WHERE turn % 4 <> 3 AND turn <> 6")
def delivered_records(spark, d):
    """Kept records with their masked fields."""
    records, texts, index = delivery_inputs(spark, d)
    v = F.try_parse_json("line")
    get = lambda path: F.try_variant_get(v, path, "string")
    return delivery.deliver(records, texts, index)["records"].select("recording", "line_no", get("$.content_raw").alias("content_raw"), get("$.merged.segments[0].speaker").alias("speaker"), get("$.model").alias("model"))


@query()
def delivered_texts(spark, d):
    records, texts, index = delivery_inputs(spark, d)
    return delivery.deliver(records, texts, index)["text"].select("recording", "line_no", "line")


@query()
def delivery_audit(spark, d):
    records, texts, index = delivery_inputs(spark, d)
    return delivery.deliver(records, texts, index)["audit"]
