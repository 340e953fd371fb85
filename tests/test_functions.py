import hashlib
import json

from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.functions import text as X
from strandline.functions.salvage import loose_json, loosely_parsed, reply_json, salvage, with_reply_json
from strandline.operators import redact, scoring, timeline


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def sed(costs, m, n):
    d = [[float(i or j) if not (i and j) else 0.0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + costs[i - 1][j - 1])
    return d[m][n]


def test_sed_cases(spark):
    for costs in ([[0.1, 0.9, 0.8], [0.7, 0.2, 0.6]], [[3 / 9, 6 / 9, 7 / 9], [6 / 9, 1 / 9, 6 / 9], [7 / 9, 7 / 9, 0.0]], [[0.28, 0.55, 0.67], [0.59, 0.15, 0.63], [0.69, 0.65, 0.09]]):
        m, n = len(costs), len(costs[0])
        c = F.array(*[F.array(*map(F.lit, r)) for r in costs])
        assert abs(one(spark, S.soft_edit_distance(c, F.lit(n))) - sed(costs, m, n)) < 1e-9
    assert one(spark, S.sed_score(F.lit(0.0), F.lit(0), F.lit(0))) == 1.0


def test_normalised(spark):
    assert abs(one(spark, S.normalised(F.lit(0.62), F.lit(0.40))) - 0.3667) < 1e-9
    assert one(spark, S.normalised(F.lit(0.2), F.lit(0.4))) == 0.0
    assert one(spark, S.normalised(F.lit(0.2), F.lit(1.0))) is None


def test_timestamps(spark):
    assert one(spark, X.strip_timestamps(F.lit("[10:00:00 -> 10:00:05] walk"))) == "walk"
    assert one(spark, X.strip_timestamps(F.lit("[04-15 10:00:00 -> 04-15 10:00:05] walk"))) == "walk"
    kept = "[04-15 10:00:00 -> 10:00:05] walk"
    assert one(spark, X.strip_timestamps(F.lit(kept))) == kept
    assert tuple(one(spark, X.time_range(F.lit("00:01–00:04")))) == ("00:01", "00:04")
    assert tuple(one(spark, X.time_range(F.lit("00:01")))) == (None, None)
    assert tuple(one(spark, X.segment_span(F.lit("00:01:00")))) == (60, 63) and one(spark, X.segment_span(F.lit("1:00"))) is None
    assert tuple(one(spark, X.segment_span(F.lit(" 9:00:00 ~ 09:00:07")))) == (32400, 32407)
    assert tuple(one(spark, X.played_span(F.lit("17:57:12–17:57:15"), F.lit(64630)))) == (2.0, 5.0)
    assert tuple(one(spark, X.played_span(F.lit("0s-5s"), F.lit(0)))) == (0.0, 5.0) and one(spark, X.played_span(F.lit("a-b"), F.lit(0))) is None


def test_recordings(spark):
    key = one(spark, X.recording_key(F.lit("4-15_hkt1323-1709_226m_ab")))
    assert tuple(key) == (4, 15, 13, 23)
    assert tuple(one(spark, X.recording_key(F.lit("other")))) == (99, 99, 99, 99)
    assert tuple(one(spark, X.recording_fields(F.lit("other"))))[:3] == ("00-00", "??:??", "??:??")
    assert one(spark, X.recording_day(F.lit("4-27_hkt1944-x"), 2026)) == "2026-04-27" and one(spark, X.recording_day(F.lit("x"), 2026)) == "9999"
    frame = one(spark, X.frame_fields(F.lit("d/2026-04-15_13-23-01_HKT__frame_12.jpg")))
    assert (frame.time.isoformat(), frame.clock, frame["index"]) == ("2026-04-15T13:23:01", "13:23:01", 12)
    assert tuple(one(spark, X.frame_fields(F.lit("frame_12.jpg")))) == (None, "", None)


def test_transcripts(spark):
    pair = lambda line: one(spark, X.transcript_interval(F.lit(line)))
    got = pair("[2026-05-17 21:30:00 HKT -> 2026-05-17 21:30:30 BJ] text")
    assert (got.start.isoformat(), got.end.isoformat()) == ("2026-05-17T21:30:00", "2026-05-17T21:30:30")
    got = pair("[00:00-00:30] text")
    assert (got.start.isoformat(), got.end.isoformat()) == ("2000-01-01T00:00:00", "2000-01-01T00:30:00")
    assert pair("text") is None
    assert one(spark, X.clean_recognised(F.lit("capture_time 1\n a\nframe_index 2\nb\n"))) == "a\nb"


def test_crops(spark):
    box = lambda x, y: tuple(one(spark, X.crop_box(F.lit(1000), F.lit(500), x, y)))
    none = F.lit(None).cast("double")
    assert box(none, none) == (345, 95, 310) and box(F.lit(0.0), F.lit(2880.0)) == (0, 190, 310) and box(F.lit(1440.0), F.lit(1440.0)) == (345, 95, 310)


def test_parsing(spark):
    raw = "We think\n1. [10:00:00 -> 10:00:01] open door\n2) sit\n3、 We go\n4. eat\n5. run"
    assert one(spark, X.numbered_items(F.lit(raw))) == ["open door", "sit", "eat"]
    assert one(spark, X.padded(F.array(F.lit("a")))) == ["a", "", ""]
    reply = 'Sure ```json\n{"candidates": [{"actions": ["a ", 3, ""]}, {"actions": []}, {"actions": ["b", "c"]}]}\n```'
    assert one(spark, X.candidate_actions(F.lit(reply), 1)) == [["a"], ["b"]]
    assert one(spark, X.judge_digit(F.lit("score\n7\nof 9"))) == 7
    assert one(spark, X.judge_digit(F.lit("I give 3 or 4."))) == 4
    assert one(spark, X.judge_digit(F.lit("none 12"))) is None
    assert one(spark, X.judge_digit(F.lit("score: 7 (v2)"))) == 7 and one(spark, X.judge_digit(F.lit("在7分 5"))) == 5
    assert one(spark, X.numbered_items(F.lit("1. press [on] button\n2. [10:00:00 -> 10:00:05] [x] go"))) == ["press [on] button", "[x] go"]
    timed = '{"candidates": [{"actions": ["[10:00:00 -> 10:00:05] walk"]}]}'
    assert one(spark, X.candidate_actions(F.lit(timed), 3)) == [["walk"]] and one(spark, X.candidate_actions(F.lit("none"), 3)) == []
    assert one(spark, X.index_spec(F.lit("1,3-5"))) == [1, 3, 4, 5]
    assert one(spark, X.date_prefix(F.array(F.lit("day1"), F.lit("day2")))) == "dayN "
    assert one(spark, X.date_prefix(F.array(F.lit("Day1"), F.lit("day2")))) == "DATE "
    kind = "array<struct<date:string,start:string,end:string,n:int>>"
    assert one(spark, X.rendered_segments(F.array().cast(kind), "Session")) == "  Session 1: (unknown)"
    two = F.array(F.struct(F.lit("04-15").alias("date"), F.lit("1").alias("start"), F.lit("2").alias("end"), F.lit(5).alias("n")), F.struct(F.lit("04-16").alias("date"), F.lit("3").alias("start"), F.lit("4").alias("end"), F.lit(None).cast("int").alias("n")))
    assert one(spark, X.rendered_segments(two, "Segment")) == "  Segment 1: 04-15 1 – 2 (5 events)\n  Segment 2: 04-16 3 – 4"
    chunks = one(spark, X.headed_chunks(F.lit("Room: a desk. Light now: dim. rest")))
    assert [tuple(c) for c in chunks] == [("Room:", "a desk."), ("Light now:", "dim. rest")]
    assert one(spark, X.endpoint(F.lit("http://h/v1/"), "/embeddings")) == "http://h/v1/embeddings"


def test_salvage(spark):
    assert json.loads(salvage('```json\n{"segments": [{"a": 1}, {"a": 2')) == {"segments": [{"a": 1}]}
    assert salvage("no json") is None and salvage(None) is None
    assert reply_json("") == (None, "empty") and reply_json("x") == (None, "unparseable") and reply_json('so ```json {"a": 1} ``` end') == ('{"a": 1}', "ok")
    assert reply_json('{"other": [{"a": 1}, {"b')[1] == "unparseable"
    rows = spark.createDataFrame([('{"a": 1}',), (None,), ('{"segments": [{"x": 1}, {"y',), ('t ```{"b": 2}```',)], "t string")
    got = [tuple(r)[1:] for r in with_reply_json(rows, "t").collect()]
    assert got == [('{"a": 1}', "ok"), (None, "empty"), ('{"segments": [{"x": 1}]}', "salvaged"), ('{"b": 2}', "ok")]
    assert loose_json('x {"a": 1}') == '{"a": 1}' and loose_json('{"a": [{"b": 1}, {"c') is None and loose_json('{"a": [{"b": 1}, {"c', True) == '{"a": [{"b": 1}]}'
    assert [r[0] for r in rows.select(loosely_parsed(F.col("t"), True)).collect()] == ['{"a": 1}', None, '{"segments": [{"x": 1}]}', '{"b": 2}']


def test_validation(spark):
    rows = spark.createDataFrame([("a", ["x"], ["y"]), ("a", [], ["y"]), ("b", None, [" "])], "id string, gt array<string>, pred array<string>")
    got = {(r.id, tuple(r.violations)) for r in scoring.validated(rows, "id", ["gt", "pred"]).collect()}
    assert got == {("a", ("duplicate id",)), ("a", ("duplicate id", "gt empty")), ("b", ("gt missing", "pred has a blank"))}


def test_quotas(spark):
    def run(counts, total):
        df = spark.createDataFrame(list(enumerate(counts)), "g int, n long")
        return [r.quota for r in timeline.allocate(df, total, ["g"]).orderBy("g").collect()]

    assert run([5, 1, 4], 10) == [5, 1, 4]
    assert run([1, 1, 1], 2) == [1, 1, 0]
    df = spark.range(6)
    assert [r.quota for r in timeline.even_split(df, 500, ["id"]).orderBy("id").collect()] == [84, 84, 83, 83, 83, 83]


def test_last_items(spark):
    assert one(spark, timeline.last_items(F.array(F.lit(1), F.lit(2)), 5)) == [1, 2]
    assert one(spark, timeline.last_items(F.array().cast("array<int>"), 5)) == []


def test_masks(spark):
    rows = spark.createDataFrame(
        [("f", 1, "Contact a.b@c.org."), ("f", 2, "token=hf_" + "a" * 24), ("f", 3, "api key: abcdef"), ("g", 4, "call 2345-6789 2222-3333"), ("g", 5, "clean text")], "rel string, line int, text string"
    )
    out = {r.line: r for r in redact.masked(rows, "text").collect()}
    assert out[1].text == "Contact XXX." and [tuple(h) for h in out[1].hits] == [("email", 1)]
    assert out[2].text == "token=XXX" and out[3].text == "api key: XXX" and out[4].text == "call XXX XXX"
    assert out[5].text == "clean text" and out[5].hits == []
    audit = {r.category: (r.n, r.files, r.locations) for r in redact.audit(redact.masked(rows, "text"), "rel", "line").collect()}
    assert audit["phone_plain_hk"] == (2, 1, 1) and audit["email"] == (1, 1, 1)


def test_names(spark):
    df = spark.createDataFrame([("Jake: hello, jake said Alice says yes. Gemini: ok",)], "t string")
    r = df.withColumn("names", redact.person_names(F.col("t"), True)).select("names", redact.mask_names(F.col("t"), F.col("names")).alias("m")).first()
    assert set(r.names) == {"Jake", "Alice"} and r.m == "XXX: hello, XXX said XXX says yes. Gemini: ok"


def test_names_of_the_corpus(spark, tmp_path):
    from strandline.plans import registry

    texts = ["Jake said hi", "I met jake, not Jakes", "Tom: hello", "then Tom left", "Anna-Lee asked", "an anna-lee.x and Anna", None, "I met jake, not Jakes"]
    spark.createDataFrame([("c", k, "user", t) for k, t in enumerate(texts)], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = ["XXX said hi", "I met XXX, not Jakes", "XXX: hello", "then Tom left", "XXX asked", "an XXX.x and Anna", None, "I met XXX, not Jakes"]
    got = {r.turn: (r.n_names, r.masked_sha1) for r in registry.person_name_masks(spark, str(tmp_path)).collect()}
    sha1 = lambda t: None if t is None else hashlib.sha1(t.encode()).hexdigest()
    assert got == {k: (n, sha1(t)) for k, (n, t) in enumerate(zip([1, 1, 1, 0, 1, 1, 0, 1], want, strict=True))}


def test_salvage_walks_back_over_any_number_of_objects():
    saved = '{"segments": [{"t": 1}'
    deep = ', {"parts": [' + ", ".join('{"k": {"v": %d}}' % k for k in range(300)) + ', {"k'
    assert json.loads(salvage(saved + deep)) == {"segments": [{"t": 1}]}
    assert json.loads(salvage(saved + ', {"at": {"x": 2}, "te')) == {"segments": [{"t": 1}, {"at": {"x": 2}}]}
    assert json.loads(salvage(saved + ', {"at": {"x": 2}')) == {"segments": [{"t": 1}, {"at": {"x": 2}}]}
