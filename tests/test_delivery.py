"""Delivery, de-identification and merging: the behaviours that a delivery has to show, and brute force in plain Python."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators import delivery, joins, merge, redact, scoring
from strandline.operators.delivery import record_names, sanitised
from strandline.plans import base, registry
from tests.oracle import SMALL


def strings(value):
    if isinstance(value, str):
        return [value]
    return [s for v in (value.values() if isinstance(value, dict) else value) for s in strings(v)] if isinstance(value, dict | list) else []


def test_a_name_in_speech_is_masked_in_every_string():
    clean, hits = sanitised({"model": "Gemini-x", "parsed": {"segments": [{"speech": "Jake: hello. Gemini: ok", "action": "Jake waves", "text_visible": ["jake's bag"]}]}})
    assert not any("jake" in s.lower() for s in strings(clean)) and clean["model"] == "Gemini-x" and "Gemini:" in clean["parsed"]["segments"][0]["speech"]
    assert hits["person_name_in_text"] >= 3


def test_fields_of_names():
    clean, hits = sanitised({"speaker": "Alice", "note": "with Alice and Alicent"})
    assert clean == {"speaker": "XXX", "note": "with XXX and Alicent"} and hits["person_name"] == 1
    assert sanitised({"speaker": "B", "note": "B plan"})[0] == {"speaker": "XXX", "note": "B plan"}
    assert sanitised({"speaker": "Me", "note": "tell Me"})[0] == {"speaker": "XXX", "note": "tell Me"}
    assert sanitised({"speaker": "Lite", "model": "x-Lite", "note": "a Lite lunch"})[0] == {"speaker": "XXX", "model": "x-Lite", "note": "a Lite lunch"}
    assert sanitised({"name": ["Alice", {"name": "Bo"}]})[0] == {"name": ["XXX", {"name": "XXX"}]}


def test_values_that_rules_mask():
    assert sanitised({"t": "Contact a.b@c.org."}) == ({"t": "Contact XXX."}, {"email": 1})
    assert sanitised({"t": "token=hf_" + "a" * 24}) == ({"t": "token=XXX"}, {"api_token": 1})
    assert sanitised({"content_raw": "a@b.org", "parsed": {"n": 3, "ok": None}}) == ({"content_raw": "XXX", "parsed": {"n": 3, "ok": None}}, {"raw_duplicate_removed": 1})


@pytest.fixture(scope="module")
def delivered(spark):
    rows = [
        ("r1", 1, {"ok": True, "clip_id": 1, "model": "m", "parsed": {"segments": [{"speech": "Tom said hi. Current: x", "speaker": "Alice"}]}}),
        ("r1", 2, {"ok": False, "clip_id": 2}),
        ("r2", 1, {"ok": True, "clip_id": 5, "model": "m", "merged": {}, "parsed": {"segments": [{"action": "sees Tom, ALICE and Current"}, {}]}}),
        ("r2", 2, {"ok": 1, "clip_id": 6}),
        ("r2", 3, None),
    ]
    records = spark.createDataFrame([(r, f"{r}/captions.jsonl", n, "{bad" if o is None else json.dumps(o)) for r, n, o in rows], "recording string, rel string, line_no long, line string")
    text = {
        "r1": ["head of Tom", "===== clip 1 =====", "Tom and Current walk  ", "", "===== clip 2 =====", "gone", "===== clip 1 =====", "  ", ""],
        "r2": ["===== clip 5 =====", "Alice at a@b.org, Current", "===== clips", "kept", "", "", ""],
        "r3": ["===== clip 9 =====", "no records here", "===== clip 10 =====", " "],
    }
    lines = [(r, f"{r}/captions.txt", i + 1, x) for r, found in text.items() for i, x in enumerate(found)]
    texts = spark.createDataFrame(lines, "recording string, rel string, line_no long, line string")
    index = spark.createDataFrame([("r1", 9, 9, True), ("r2", 9, 4, False), ("r4", 3, 3, True)], "recording string, usable_clips long, target_clips long, in_first_100h boolean")
    return delivery.deliver(records, texts, index)


def test_names_go_through_the_whole_corpus(delivered):
    got = {(r.recording, r.line_no): json.loads(r.line) for r in delivered["records"].collect()}
    assert set(got) == {("r1", 1), ("r2", 1)}
    assert got["r1", 1]["parsed"]["segments"] == [{"speech": "XXX said hi. XXX: x", "speaker": "XXX"}]
    # a prefix in one record is no sign for others
    assert got["r2", 1]["parsed"]["segments"][0]["action"] == "sees XXX, XXX and Current"
    text = {}
    for r in sorted(delivered["text"].collect(), key=lambda r: (r.rel, r.line_no)):
        text.setdefault(r.recording, []).append(r.line)
    assert text["r1"] == ["head of XXX", "===== clip 1 =====", "XXX and XXX walk"]
    assert text["r2"] == ["===== clip 5 =====", "XXX at XXX, Current", "===== clips", "kept"]
    assert text["r3"] == ["===== clip 9 =====", "no records here"]


def test_index_and_audit_of_a_delivery(delivered):
    index = {r.recording: r for r in delivered["index"].collect()}
    one = index["r1"]
    assert (one.usable_clips, one.selected_candidate_clips, one.target_clips, one.source_planned_target_clips, one.coverage, one.segments, one.models) == (1, 2, 2, 9, 0.5, 1, {"m": 1})
    assert (index["r2"].usable_clips, index["r2"].coverage, index["r2"].segments) == (1, 0.333, 2)
    assert (index["r4"].usable_clips, index["r4"].coverage, index["r4"].selected_candidate_clips) == (3, None, None)
    s = delivered["summary"].first()
    assert (s.usable_clips_total, s.selected_candidate_clips_total, s.first_100h_usable, s.first_100h_target, s.first_100h_coverage, s.recordings_with_output) == (5, 5, 4, 2, 2.0, 3)
    audit = {r.category: (r.n, r.files, r.locations) for r in delivered["audit"].collect()}
    assert audit["person_name"] == (1, 1, 1) and audit["email"] == (1, 1, 1) and audit["person_name_in_text"][0] >= 7
    where = [r.location for r in delivered["audit_locations"].filter("category = 'email'").collect()]
    assert where == [hashlib.sha256(b"r2/captions.txt:2").hexdigest()[:16]]


def test_a_delivery_is_written_once(delivered, tmp_path):
    delivery.write_delivery(delivered, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        delivery.write_delivery(delivered, str(tmp_path / "out"))


def test_other_files_are_copied(spark, tmp_path):
    for name in ("r1/captions.jsonl", "r1/note.md", "index.json", "r2/deep/a.bin"):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode() * 3)
    got = delivery.copied_files(spark, str(tmp_path / "src"), str(tmp_path / "dst")).collect()
    assert {r.rel: r.length for r in got} == {"r1/note.md": 30, "r2/deep/a.bin": 39}
    found = {str(f.relative_to(tmp_path / "dst")): f.read_bytes() for f in (tmp_path / "dst").rglob("*") if f.is_file()}
    assert found == {x: x.encode() * 3 for x in ("r1/note.md", "r2/deep/a.bin")}


def _plain_masked(text, rules):
    hits = {}
    for category, pattern, new in rules:
        text, n = re.subn(pattern, re.sub(r"\$(\d)", r"\\g<\1>", new), text)
        if n:
            hits[category] = hits.get(category, 0) + n
    return text, hits


@pytest.mark.parametrize("rules", [redact.DELIVERY_RULES, redact.placeholder_rules(base.INSTITUTIONS), redact.archived_rules("example university")])
def test_rules_mask_as_python_does(spark, rules):
    rng = random.Random(3)
    parts = [
        "a.b@c.org", "token", "password: s3cret", "api key = abc", "密码是 abcd12", "sk-" + "a" * 24, "Bearer " + "x" * 20, "+852 2345 6789", "13812345678", "2345-6789 2222-3333", "4111 1111 1111 1111",
        "https://x.org/a", "/Users/me/x", "粤B12345", "A1_JAKE", "User_3", "HK$ 12.50", "商户:店", "地址　九龙", "8.8.8.8", "192.168.1.4", "Dr. Jane Roe", "王老师", "EXU", "sample college", "1234-5678a", "在ABC", "é１２３４", "zoom.us/j/1", "A123456(7)", "mac@host", "姓名：李", "　", " ", ", ",
    ]
    texts = ["".join(rng.choice([*parts, " ", ". "]) for _ in range(8)) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in redact.masked(rows, "t", rules).collect():
        hits = {}
        for h in r.hits:
            hits[h.category] = hits.get(h.category, 0) + h.n
        assert (r.t, hits) == _plain_masked(texts[r.i], rules), texts[r.i]


def test_masking_queries_equal_python(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = {d: _plain_masked(t, redact.DELIVERY_RULES) for d, _, t in docs}
    got = {r.doc_id: (r.text_sha1, r.n) for r in registry.queries()["mask_delivery"](spark, SMALL).collect()}
    assert got == {d: (hashlib.sha1(t.encode()).hexdigest(), sum(h.values())) for d, (t, h) in want.items()}
    for name, rules in (("redaction_audit", redact.DELIVERY_RULES), ("placeholder_audit", redact.placeholder_rules(base.INSTITUTIONS)), ("archived_masks", redact.archived_rules("example university"))):
        sums: dict = {}
        for d, s, t in docs:
            for c, n in _plain_masked(t, rules)[1].items():
                sums.setdefault(c, [0, set(), set()])
                sums[c][0] += n
                sums[c][1].add(s)
                sums[c][2].add((s, d))
        found = {r.category: (r.n, r.files, r.locations) for r in registry.queries()[name](spark, SMALL).collect()}
        assert found == {c: (n, len(f), len(x)) for c, (n, f, x) in sums.items()}


def test_placeholder_report_counts_before_and_after(spark):
    docs = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rules = redact.placeholder_rules(base.INSTITUTIONS)
    after = [_plain_masked(t, rules)[0] for t in docs]
    count = lambda texts, p: sum(len(re.findall(p, t)) for t in texts)
    got = {r.category: (r.before, r.after) for r in registry.queries()["placeholder_report"](spark, SMALL).collect()}
    assert got == {c: (count(docs, p), count(after, p)) for c, p in redact.placeholder_audit_categories(base.INSTITUTIONS)}


def test_name_masks_equal_python(spark):
    rows = [(r.conv_id, r.turn, r.text) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    attributed = [re.compile(p) for p in (redact.ATTRIBUTED, redact.ATTRIBUTED_ENGLISH)]
    signal = lambda t, patterns: {n for p in patterns for n in p.findall(t) if n.lower() not in redact.NON_PERSON}
    corpus = set().union(*(signal(t, attributed) for _, _, t in rows))
    hide = lambda t, names: re.sub(rf"(?i)(?<![A-Za-z])(?:{'|'.join(map(re.escape, sorted(names, key=lambda n: (-len(n), n.lower()))))})(?![A-Za-z])", "XXX", t) if names else t
    want = {}
    for c, k, t in rows:
        want[c, k] = hashlib.sha1(hide(t, corpus | signal(t, [*attributed, re.compile(redact.SPEAKER_PREFIX)])).encode()).hexdigest()
    assert {(r.conv_id, r.turn): r.masked_sha1 for r in registry.queries()["person_name_masks"](spark, SMALL).collect()} == want


def test_delivered_texts_equal_python(spark):
    from strandline.plans import clips

    records, texts, _ = clips.delivery_inputs(spark, SMALL)
    parsed = []
    for r in records.collect():
        try:
            o = json.loads(r.line)
        except ValueError:
            continue
        if o["ok"] is True:
            parsed.append((r.recording, o["clip_id"], o, r))
    corpus = set().union(*(record_names(o)[1] for *_, o, _ in parsed))
    own = {(rec, k): record_names(o)[0] for rec, k, o, _ in parsed}
    want, block = {}, {}
    for t in sorted(texts.collect(), key=lambda t: (t.rel, t.line_no)):
        if t.line.startswith("====="):
            block = {"id": (t.recording, int(t.line.split()[2])), "rows": []}
            want[block["id"]] = block["rows"]
        block["rows"].append(t)
    out = []
    for key, lines in want.items():
        if key in own and any(x.line.strip() for x in lines[1:]):
            for x in lines:
                out.append((x.recording, x.line_no, delivery._Cleaner(sorted(corpus | own[key])).text(x.line.rstrip()).rstrip()))
    last = {}
    for rec, n, line in out:
        if line:
            last[rec] = max(n, last.get(rec, 0))
    got = sorted(tuple(r) for r in registry.queries()["delivered_texts"](spark, SMALL).collect())
    assert got == sorted(x for x in out if x[1] <= last[x[0]])
    assert {r.category for r in registry.queries()["delivery_audit"](spark, SMALL).collect()} >= {"person_name", "raw_duplicate_removed"}


def test_merge_outputs(spark, tmp_path):
    schema = "recording string, clip_id long, ok boolean, clip_start string, clip_end string, has_gaze boolean, model string, tokens_in long, tokens_out long, tokens_think long, parsed struct<scene_summary:string,activity_chain:string,segments:array<struct<time_range:string,action:string,environment:string,speech:string,text_visible:array<string>,objects:array<string>,details:string>>>"
    seg = lambda t, a, s=None: (t, a, None, s, ["x", "y"], [], "")
    clips = [
        ("r1", 2, True, "2026-04-15 10:00:30", "2026-04-15 10:01:00", False, "b", 100, 10, None, ("two", "", [seg("9:59:00-10:00:00", "late"), seg("10:00:35–10:00:40", "early", "hi")])),
        ("r1", 1, False, "2026-04-15 10:00:00", "2026-04-15 10:00:30", True, "a", None, None, None, None),
        ("r0", 1, True, None, None, None, "c", 1_000_000, 0, 1_000_000, ("", "", [seg("", "User A mails q@example.com and q@x.org")])),
    ]
    merged = merge.merged_recordings(spark.createDataFrame(clips, schema), r"\bexample school\b").cache()
    r1, r0 = (merged.filter(F.col("recording") == x).first() for x in ("r1", "r0"))
    assert (r1.clip_count, r1.clip_ok, r1.failed_clip_ids, r1.time_start, r1.time_end, r1.has_gaze, r1.model) == (2, 1, [1], "2026-04-15 10:00:00", "2026-04-15 10:01:00", True, "a")
    assert [s.segment.action for s in r1.segments] == ["early", "late"]  # start strings, not times
    assert r0.est_cost_usd == 4.5 and (r0.pii_audit.email_plain, r0.pii_audit.anonymized_placeholders, r0.pii_audit.total_hits) == (1, 1, 1)
    text = merge.recording_text(merged).filter("recording = 'r1'").first().text.split("\n")
    assert text[:5] == ["# r1", "日期 2026-04-15   2026-04-15 10:00:00 → 2026-04-15 10:01:00", "clip 1/2 成功   segments 2   眼动 有   模型 a", "", "── clip_0001  10:00:00–10:00:30  [FAILED]"]
    assert text[5:] == ["", "── clip_0002  10:00:30–10:01:00  ", "   « two »", "   [10:00:35–10:00:40] early", "       语音: hi", "       文字: x, y", "   [9:59:00-10:00:00] late", "       文字: x, y", ""]
    days = merge.merged_days(merged.withColumn("date", F.lit("d")))
    day = days.first()
    assert [r.recording for r in day.recordings] == ["r0", "r1"] and (day.recording_count, day.segment_count, day.clip_ok, day.clip_count) == (2, 3, 2, 3)
    lines = merge.day_text(days).first().text.split("\n")
    assert lines[0] == "# d 全天 caption" and lines.count("══ r0") == lines.count("══ r1") == 1 and "  · r1  10:00:00→10:01:00  2 segs  眼动有" in lines
    merge.write_recordings(merged, str(tmp_path / "rec"))
    merge.write_days(days, str(tmp_path / "day"))
    assert spark.read.json(str(tmp_path / "rec/segments")).count() == 3 and spark.read.json(str(tmp_path / "day/segments")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        merge.write_days(days, str(tmp_path / "day"))


def test_providers_are_tried_again(spark):
    calls = []

    def judge(gt, pred, context):
        if gt == "bad":
            raise OSError
        return "7" if context else "no digit"

    pairs = spark.createDataFrame([("a", "b", "c"), ("a", "d", ""), ("bad", "b", "c")], "gt string, pred string, context string")
    got = scoring.judged(pairs, judge, 2, calls.append).collect()
    assert {(r.gt, r.pred): r.score for r in got} == {("a", "b"): 7, ("a", "d"): None, ("bad", "b"): None}
    points = spark.createDataFrame([("2", "s", "one", ["x", "y", "z"]), ("1", "s", "none", ["x"])], "id string, system string, user string, ground_truth array<string>")
    got = scoring.predicted(points, lambda system, user: '{"candidates": [{"actions": ["[10:00:00 -> 10:00:01] go", "b", "c"]}]}' if user == "one" else "sorry", 2, wait=calls.append).collect()
    assert [tuple(r) for r in got] == [("2", ["x", "y"], [["go", "b"]])]


def test_refused_samples(spark):
    rows = spark.createDataFrame([("a", ["x"]), ("b", [])], "id string, gt array<string>")
    with pytest.raises(Exception, match="sample b: gt empty"):
        scoring.refused(scoring.validated(rows, "id", ["gt"]), "id").collect()
    with pytest.raises(ValueError, match="no method"):
        scoring.evaluate(rows, "none")


def test_points_with_nulls_keep_their_hits(spark):
    points = spark.createDataFrame([("a", 5, None), ("a", 50, "x"), ("b", 5, None), (None, 5, "y")], "k string, t int, note string")
    spans = spark.createDataFrame([("a", 0, 10, "one"), ("a", 3, 9, "two"), ("a", 100, 110, "far")], "k string, s0 int, s1 int, name string")
    got = {(r.k, r.t): r.name for r in joins.containing(points, spans, ["k"], "t", ("s0", "s1"), "s0", 4).collect()}
    assert got == {("a", 5): "one", ("a", 50): None, ("b", 5): None, (None, 5): None}
    got = {(r.k, r.t): r.name for r in joins.containing_or_nearest(points, spans, ["k"], "t", ("s0", "s1"), "name", 4).collect()}
    assert got == {("a", 5): "one", ("a", 50): "two", ("b", 5): None, (None, 5): None}


def test_nearest_over_buckets(spark):
    rng = random.Random(1)
    points = [(k, rng.randrange(2000)) for k in (1, 2) for _ in range(60)]
    marks = sorted({(k, rng.randrange(2000)) for k in (1, 1, 2) for _ in range(15)})
    got = joins.nearest(spark.createDataFrame(points, "k int, t int"), spark.createDataFrame([(k, m, m) for k, m in marks], "k int, m int, it int"), ["k"], "t", "m", "it", 100).collect()
    want = sorted((k, t, min((abs(t - m), m) for j, m in marks if j == k)[1]) for k, t in points)
    assert sorted(map(tuple, got)) == want


def test_prefixes_either_way(spark):
    names = ["abc", "abcdef", "abcdefgh", "abx", "b", "", "zz"]
    df = spark.createDataFrame([(x,) for x in names], "a string")
    got = sorted(map(tuple, joins.by_prefix(df, df.withColumnRenamed("a", "b"), "a", "b", 4).collect()))
    assert got == sorted((x, y) for x in names for y in names if x.startswith(y[:4]) or y.startswith(x[:4]))
