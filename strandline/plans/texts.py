"""Queries of the text functions. Their inputs are made from the events' ids, so SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions.salvage import loosely_parsed, with_reply_json
from strandline.operators import captions, redact
from strandline.plans.base import events, query, table
from strandline.sources import files

def _id() -> Column:
    return F.col("event_id")


def _text(c: Column) -> Column:
    return c.cast("string")


def _choose(*values: Column | str) -> Column:
    """One of the values by the event's id."""
    n = len(values)
    return F.coalesce(*[F.when(_id() % n == k, v if isinstance(v, Column) else F.lit(v)) for k, v in enumerate(values)])


def _glue(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10:00:0' || event_id % 10 WHEN 1 THEN 'a' END AS start, CASE event_id % 3 WHEN 0 THEN '10:01:00' WHEN 1 THEN 'b-c' END AS \"end\" FROM events")
def time_ranges(spark, d):
    r = X.time_range(_choose(_glue(" 10:00:0", _text(_id() % 10), " – 10:01:00 "), "a-b-c", "no range"))
    return events(spark, d).select("event_id", r["start"].alias("start"), r["end"].alias("end"))


@query("SELECT event_id, 'press [on] ' || event_type AS text FROM events")
def leading_brackets(spark, d):
    return events(spark, d).select("event_id", X.without_leading_bracket(_choose(_glue("[10:00 -> 10:01] press [on] ", F.col("event_type")), _glue("press [on] ", F.col("event_type")))).alias("text"))


@query(
    """WITH t AS (SELECT event_id, event_id % 7 = 3 AS odd, event_id % 12 + 1 AS m, event_id % 28 + 1 AS dd, event_id % 24 AS h FROM events)
SELECT event_id, CASE WHEN odd THEN '00-00' ELSE printf('%02d-%02d', m, dd) END AS date, CASE WHEN odd THEN '??:??' ELSE printf('%02d:05', h) END AS start, CASE WHEN odd THEN '??:??' ELSE printf('%02d:59', h) END AS "end",
 CASE WHEN odd THEN '9999' ELSE printf('2026-%02d-%02d', m, dd) END AS day, CASE WHEN odd THEN 99 ELSE m END AS month_key FROM t"""
)
def recording_names(spark, d):
    hour = F.lpad(_text(_id() % 24), 2, "0")
    name = F.when(_id() % 7 == 3, "not_a_recording").otherwise(_glue(_text(_id() % 12 + 1), "-", _text(_id() % 28 + 1), "_hkt", hour, "05-", hour, "59_54m_", _text(_id())))
    f = X.recording_fields(name)
    return events(spark, d).select("event_id", f["date"].alias("date"), f["start"].alias("start"), f["end"].alias("end"), X.recording_day(name, 2026).alias("day"), X.recording_key(name)["month"].cast("long").alias("month_key"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '' ELSE printf('13:%02d:01', event_id % 60) END AS clock, CASE WHEN event_id % 4 <> 3 THEN event_id END AS index,
CASE WHEN event_id % 4 <> 3 THEN printf('2026-04-15 13:%02d:01', event_id % 60) END AS time FROM events"""
)
def frame_names(spark, d):
    stem = _glue("frames/2026-04-15_13-", F.lpad(_text(_id() % 60), 2, "0"), "-01_")
    f = X.frame_fields(_choose(_glue(stem, "HKT__frame_", _text(_id()), ".jpg"), _glue(stem, "BJ__frame_", _text(_id()), ".txt"), _glue(stem, "hkt__frame_", _text(_id()), ".PNG"), "cover.jpg"))
    return events(spark, d).select("event_id", f["clock"].alias("clock"), f["index"].cast("long").alias("index"), F.date_format(f["time"], "yyyy-MM-dd HH:mm:ss").alias("time"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2026-05-17 21:30:00' WHEN 1 THEN '2026-05-17 21:30:00' WHEN 2 THEN printf('2000-01-01 00:00:%02d', event_id % 30) END AS start,
CASE event_id % 4 WHEN 0 THEN '2026-05-17 21:30:30' WHEN 1 THEN '2026-05-18 00:00:05' WHEN 2 THEN printf('2000-01-01 01:02:%02d', event_id % 30) END AS "end" FROM events"""
)
def transcript_lines(spark, d):
    s = F.lpad(_text(_id() % 30), 2, "0")
    line = _choose("[2026-05-17 21:30:00 HKT -> 2026-05-17 21:30:30 HKT] hello", "[2026-05-17 21:30:00 -> 2026-05-18 00:00:05 BJ] hi", _glue("[00:00:", s, "–1:02:", s, "] later"), "no times")
    r = X.transcript_interval(line)
    return events(spark, d).select("event_id", F.date_format(r["start"], "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format(r["end"], "yyyy-MM-dd HH:mm:ss").alias("end"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 50 WHEN 1 THEN event_id % 50 WHEN 2 THEN 5.0 WHEN 3 THEN 7.5 END AS start,
CASE event_id % 5 WHEN 0 THEN event_id % 50 + 60 WHEN 1 THEN event_id % 50 + 2 WHEN 2 THEN 9.0 WHEN 3 THEN 30.0 END AS "end",
CASE event_id % 5 WHEN 0 THEN 64800 + event_id % 50 WHEN 1 THEN 64800 + event_id % 50 END AS first, CASE event_id % 5 WHEN 0 THEN 64860 + event_id % 50 WHEN 1 THEN 64802 + event_id % 50 END AS last FROM events"""
)
def played_spans(spark, d):
    """Ranges of segments as the player and the reviewer read them."""
    s = F.lpad(_text(_id() % 50), 2, "0")
    c = _choose(_glue("18:00:", s, " – 18:01:", s), _glue("18:00:", s, "-18:00:", F.lpad(_text(_id() % 50 + 2), 2, "0")), "5s-9s", "7.5", "soon")
    p, r = X.played_span(c, X.base_seconds(F.array(F.lit("x"), F.lit("18:00:00-18:00:30")))), X.segment_span(c)
    return events(spark, d).select("event_id", p["start"].alias("start"), p["end"].alias("end"), r["start"].cast("long").alias("first"), r["end"].cast("long").alias("last"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'open ' || event_type || '|press [on] button|sit' WHEN 1 THEN 'run||' ELSE '||' END AS items, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS n FROM events")
def numbered_lists(spark, d):
    raw = _choose(_glue("We think:\n 1. [10:00:00 -> 10:00:05] open ", F.col("event_type"), "\n2) press [on] button\n3、 We go\n4] sit\n5. run"), "1. Need more\n2.\n3. run", "nothing")
    items = X.numbered_items(raw)
    return events(spark, d).select("event_id", F.array_join(X.padded(items), "|").alias("items"), F.size(items).alias("n"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,' || event_type || ';c,d' WHEN 1 THEN 'x' WHEN 2 THEN 'walk' ELSE '' END AS candidates FROM events")
def candidate_replies(spark, d):
    raw = _choose(
        _glue('```json\n{"candidates": [{"actions": ["a ", 3, "", "', F.col("event_type"), '", "z"]}, {"actions": []}, {"actions": ["c", "d"]}]}\n```'),
        'Sure: {"candidates": [{"actions": ["x"], "probability": 0.5}]} as asked',
        '{"candidates": [{"actions": ["[10:00:00 -> 10:00:05] walk"]}, {"other": 1}]}',
        "no candidates {",
    )
    found = X.candidate_actions(raw, 2)
    return events(spark, d).select("event_id", F.array_join(F.transform(found, lambda c: F.array_join(c, ",")), ";").alias("candidates"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id % 10 WHEN 1 THEN 7 WHEN 2 THEN 4 WHEN 3 THEN 8 END AS score FROM events")
def judge_replies(spark, d):
    raw = _choose(_glue("I think\n ", _text(_id() % 10), " \nof 9"), "score: 7 (v2)", "3 or 4.", "A 8", "none 12 or 3rd")
    return events(spark, d).select("event_id", X.judge_digit(raw).cast("long").alias("score"))


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'salvaged' WHEN 3 THEN 'salvaged' WHEN 4 THEN 'unparseable' ELSE 'empty' END AS note,
CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 END AS n, CASE WHEN event_id % 6 < 4 THEN event_id END AS t FROM events"""
)
def salvaged_replies(spark, d):
    one = _glue('{"segments": [{"t": ', _text(_id()), "}")
    raw = _choose(_glue(one, "]}"), _glue("Here:\n```json\n", one, "]}\n```\nDone"), _glue(one, ', {"t": 5, "at": [{"x": 1}, {"x'), _glue(one, ', {"t": 5, "at": {"x": 1}, "te'), "no json", "")
    rows = with_reply_json(events(spark, d).select("event_id", raw.alias("raw")), "raw")
    v = F.try_parse_json("json")
    return rows.select("event_id", "note", F.size(F.try_variant_get(v, "$.segments", "array<variant>")).cast("long").alias("n"), F.try_variant_get(v, "$.segments[0].t", "long").alias("t")).withColumn("n", F.when(F.col("note").isin("ok", "salvaged"), F.col("n")))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN event_id END AS loose, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN NULL WHEN 2 THEN event_id END AS strict FROM events")
def loose_replies(spark, d):
    raw = _choose(_glue("```json\n", '{"t": ', _text(_id()), "}\n```"), _glue('{"t": ', _text(_id()), ', "s": [{"a": 1}, {"b'), _glue('{"t": ', _text(_id()), "}"), "none")
    rows = events(spark, d).select("event_id", raw.alias("raw"))
    t = lambda c: F.try_variant_get(F.try_parse_json(c), "$.t", "long")
    return rows.select("event_id", t(loosely_parsed(F.col("raw"), True)).alias("loose"), t(loosely_parsed(F.col("raw"))).alias("strict"))


_TEMPLATE = "Predict {k} after {n_context_segments}:\n{context_segments}\nfor\n{target_segments}\nlike {action_example}({date_prefix})"


@query(
    """WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), a AS (SELECT conv_id, count(*) AS m, string_agg('  Session ' || (turn + 1) || ': day' || turn || ' ' || role || ' – x (' || n || ' events)', chr(10) ORDER BY turn) AS s,
 string_agg(role, chr(10) ORDER BY turn) AS lines, min_by(role, turn) AS first_role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM c) WHERE i = turn GROUP BY conv_id),
p AS (SELECT *, CASE WHEN m > 1 THEN 'dayN ' ELSE '' END AS pre FROM a)
SELECT conv_id, 'Predict 1 after ' || m || ':' || chr(10) || s || chr(10) || 'for' || chr(10) || '  Segment 1: day0 ' || first_role || ' – x' || chr(10) || 'like [' || pre || 'HH:MM:SS -> ' || pre || 'HH:MM:SS] (' || pre || ')' AS system,
 'Event history (' || m || ' events, oldest first):' || chr(10) || chr(10) || lines AS "user" FROM p"""
)
def point_prompts(spark, d):
    c = table(spark, d, "conversations")
    first = F.sort_array(F.collect_list(F.struct("turn", "role", F.char_length("text").alias("n"))))
    rows = c.groupBy("conv_id").agg(first.alias("t"))
    rows = rows.withColumn("t", F.filter("t", lambda x, i: x["turn"] == i))
    segment = lambda x, n: F.struct(F.concat(F.lit("day"), _text(x["turn"])).alias("date"), x["role"].alias("start"), F.lit("x").alias("end"), n.alias("n"))
    rows = rows.withColumn("context", F.transform("t", lambda x: segment(x, x["n"]))).withColumn("target", F.transform("t", lambda x: segment(x, F.lit(None).cast("int"))))
    p = X.point_prompt(_TEMPLATE, 1, F.col("context"), F.slice("target", 1, 2), F.transform("t", lambda x: x["role"]))
    return rows.filter(F.size("t") > 0).select("conv_id", p["system"].alias("system"), p["user"].alias("user"))


@query("SELECT doc_id, md5('(' || coalesce(CASE WHEN text = '' THEN '(no text detected)' WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || '... (OCR truncated, remaining frames omitted)' ELSE text END, '(no text detected)') || ')') AS block FROM documents WHERE text IS NOT NULL")
def clip_contexts(spark, d):
    docs = table(spark, d, "documents").filter("text is not null")
    shown = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.array("text"))
    context = X.clip_context(F.lit("2026-04-15 13:00:00"), F.lit("2026-04-15 13:00:30"), F.lit(30), F.lit("13:00:00"), F.lit("13:00:29"), F.lit(""), shown, 1000)
    block = F.split_part(F.split_part(context, F.lit("HKT timestamps)\n"), F.lit(2)), F.lit("\n\n## Video Frames"), F.lit(1))
    return docs.select("doc_id", F.md5(F.concat(F.lit("("), block, F.lit(")"))).alias("block"))


@query("SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'Room:>a ' || event_type || '.|Light now:>dim. and warm' ELSE '>plain text. no heading' END AS chunks FROM events")
def headed_texts(spark, d):
    chunks = X.headed_chunks(_choose(_glue(" Room: a ", F.col("event_type"), ".  Light now: dim. and warm "), "plain text. no heading"))
    return events(spark, d).select("event_id", F.array_join(F.transform(chunks, lambda c: F.concat_ws(">", c["heading"], c["rest"])), "|").alias("chunks"))


@query(
    """WITH t AS (SELECT event_id, 297 AS side, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 7 % 2880 END AS x, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 11 % 2880 END AS y FROM events)
SELECT event_id, CAST(greatest(0, least(640 - side, trunc(coalesce(x * 640 / 2880.0, 320.0) - side / 2.0))) AS BIGINT) AS "left", CAST(greatest(0, least(480 - side, trunc(coalesce(y * 480 / 2880.0, 240.0) - side / 2.0))) AS BIGINT) AS top, CAST(side AS BIGINT) AS side FROM t"""
)
def crop_boxes(spark, d):
    gaze = lambda k: F.when(_id() % 3 != 0, (_id() * k % 2880).cast("double"))
    box = X.crop_box(F.lit(640), F.lit(480), gaze(7), gaze(11))
    return events(spark, d).select("event_id", *[box[k].cast("long").alias(k) for k in ("left", "top", "side")])


@query("SELECT event_id, 'http://h' || event_id || '/v1/embeddings' AS url FROM events")
def endpoints(spark, d):
    base = _glue("http://h", _text(_id()))
    return events(spark, d).select("event_id", X.endpoint(_choose(base, _glue(base, "/"), _glue(base, "/v1"), _glue(base, "/v1/embeddings/")), "/embeddings").alias("url"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '0,1,2,3,4' WHEN 2 THEN '1,3,4,5' ELSE '2,7' END AS indices FROM events")
def index_specs(spark, d):
    return events(spark, d).select("event_id", F.array_join(F.transform(X.index_spec(_choose("3", "0-4", "1,3-5", "[2, 7]")), _text), ",").alias("indices"))


@query("SELECT DISTINCT text, 'm|64|' || sha1(text) AS key FROM documents WHERE text IS NOT NULL")
def cache_keys(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("text").distinct().select("text", files.cache_key(F.col("text"), "m", 64).alias("key"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'kept' ELSE 'failed' END AS state FROM events")
def strictly_ok_records(spark, d):
    line = _choose('{"ok": true, "clip_id": 1}', '{"ok": 1}', '{"ok": "true"}', '{"ok": false}', "{}", "[true]")
    return captions.strictly_ok(events(spark, d).select("event_id", F.parse_json(line).alias("v")), "v").select("event_id", "state")


@query("SELECT event_id, event_id % 3 <> 1 AS kept, CASE event_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'p' END AS body FROM events")
def explicit_failures(spark, d):
    """What is kept where only an explicit false drops, and which of two bodies counts: the first that holds anything."""
    ok = _choose(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))
    empty = F.array().cast("array<string>")
    body = captions.truthy(_choose(F.array(F.lit("m")), empty, empty), _choose(F.array(F.lit("p")), F.array(F.lit("p")), F.lit(None).cast("array<string>")))
    return events(spark, d).select("event_id", captions.not_failed(ok).alias("kept"), F.get(body, F.lit(0)).alias("body"))


@query("SELECT event_id, 'k:' || event_id AS kept FROM events")
def private_keys(spark, d):
    m = F.create_map(F.lit("_summary"), _text(_id()), F.lit("k"), _text(_id()), F.lit("_redaction"), F.lit("x"))
    return events(spark, d).select("event_id", F.array_join(F.transform(F.map_entries(captions.without_private(m)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("kept"))


@query("SELECT event_id, 'price ' || event_id || chr(10) || 'sale' AS text FROM events")
def recognised_texts(spark, d):
    return events(spark, d).select("event_id", X.clean_recognised(_glue("capture_time: 1\nprice ", _text(_id()), "\nframe_index 4\nsale\ncapture_epoch=2\n ")).alias("text"))


_MARKS = [("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}", "E"), ("digits", "[0-9]{7,}", "N")]


@query(
    f"""WITH t AS (SELECT text AS a, regexp_replace(regexp_replace(text, '{_MARKS[0][1]}', 'E', 'g'), '{_MARKS[1][1]}', 'N', 'g') AS b FROM documents)
SELECT 'email' AS category, CAST(sum(len(regexp_extract_all(a, '{_MARKS[0][1]}'))) AS BIGINT) AS before, CAST(sum(len(regexp_extract_all(b, '{_MARKS[0][1]}'))) AS BIGINT) AS after FROM t
UNION ALL SELECT 'digits', CAST(sum(len(regexp_extract_all(a, '{_MARKS[1][1]}'))) AS BIGINT), CAST(sum(len(regexp_extract_all(b, '{_MARKS[1][1]}'))) AS BIGINT) FROM t"""
)
def masks_before_and_after(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return redact.before_and_after(docs, "text", _MARKS, [(c, p) for c, p, _ in _MARKS])


@query()
def archived_masks(spark, d):
    rows = redact.masked(table(spark, d, "documents").select("doc_id", "source", "text"), "text", redact.archived_rules("example university"))
    return redact.audit(rows, "source", "doc_id")


@query()
def placeholder_report(spark, d):
    from strandline.plans.base import INSTITUTIONS

    docs = table(spark, d, "documents").select("doc_id", "text")
    return redact.before_and_after(docs, "text", redact.placeholder_rules(INSTITUTIONS), redact.placeholder_audit_categories(INSTITUTIONS))
