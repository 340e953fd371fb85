import hashlib
import http.server
import io
import random
import tarfile
import threading

import pytest
from pyspark.sql import functions as F

from strandline.operators import scoring, timeline
from strandline.sources import files, ranges, tar
from strandline.streaming import incremental


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r.id for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nnope\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "id int").collect()
    nan = F.lit(float("nan"))
    for k, x in enumerate((nan, F.array(nan), F.struct(F.lit(1).alias("a"), F.array(F.struct(nan.alias("b"))).alias("c")), F.create_map(F.lit("k"), nan), F.lit(float("inf")))):
        with pytest.raises(Exception, match="NaN"):
            files.write_jsonl(spark.range(1).select(x.alias("x")), str(tmp_path / f"out{k}"))
    fine = spark.range(2).select("id", F.array(F.lit(1.5), F.lit(None).cast("double")).alias("x"), F.struct(F.lit("é").alias("s")).alias("y"))
    files.write_jsonl(fine, str(tmp_path / "fine"))
    assert sorted(map(str, spark.read.json(str(tmp_path / "fine")).select("id", "x", "y").collect())) == sorted(map(str, fine.collect()))
    assert [r.id for r in files.page(spark.range(10), "id", 3, 2).collect()] == [3, 4] and files.page(spark.range(10), "id", 3).count() == 7


def test_lines(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a b\n\nb c\n")
    assert [r.line for r in files.numbered_lines(spark, str(tmp_path / "e.txt")).orderBy("line_no").collect()] == ["a b", "b", "c"]
    assert [r.line for r in files.numbered_lines(spark, str(tmp_path / "e.txt"), True).orderBy("line_no").collect()] == ["a b", "", "b", "c"]


def test_lenient_clips_and_inventory(spark, tmp_path):
    for name, text in (("clip_2.json", '{"clip_id": 7, "ok": true}'), ("clip_1.json", '{"ok": false}'), ("clip_3.json", '{"clip_id": 3'), ("clip_4.json", "")):
        (tmp_path / name).write_text(text)
    got = files.read_json_lenient(spark, str(tmp_path / "clip_*.json")).orderBy("clip_id").collect()
    assert [r.clip_id for r in got] == [0, 7]
    for place, text in (("ego/A1_X/L1/day1", "a\n\nb\n"), ("ego/A1_X/L1/day2", "c"), ("ego/.hidden/L1/day1", "d"), ("next/u/L5/r1", "e\x0bf\u2028g")):
        path = tmp_path / "data" / f"{place}.txt"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    lines = lambda keep: files.numbered_lines(spark, str(tmp_path / "data/*/*/*/*.txt"), keep)
    count = lambda keep: {(r.source, r.participant, r.level, r.day): r.events for r in files.inventory(lines(keep)).collect()}
    assert count(True) == {("ego", "A1_X", "L1", "day1"): 3, ("ego", "A1_X", "L1", "day2"): 1, ("next", "u", "L5", "r1"): 3}
    assert count(False)["ego", "A1_X", "L1", "day1"] == 2


def test_replies(spark, tmp_path):
    chunk = '{"candidates":[{"content":{"parts":[{"text":"%s"%s}]}}],"usageMetadata":{"promptTokenCount":5,"candidatesTokenCount":%d}}'
    lines = [chunk % ("hm", ',"thought":true', 1), chunk % ("```json\\n{}", "", 2), chunk % ("\\n```", "", 3)]
    (tmp_path / "r.sse").write_text("\n\n".join("data: " + x for x in lines))
    r = files.replies(files.reply_chunks(spark, str(tmp_path / "r.sse"))).first()
    assert (r.payload, r.chunks, r.tokens_out) == ("{}", 3, 3)


def test_cache(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    cache = requests.filter("text = 'a'").distinct().select(F.sha1("text").alias("key"), F.lit(1).alias("v"))
    hit, miss = files.cached(requests, cache)
    assert [r.text for r in hit.collect()] == ["a"] and [r.text for r in miss.collect()] == ["b"]


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w", format=tarfile.GNU_FORMAT) as t:
        for name, data in (("frames/a.jpg", b"1" * 700), ("meta/" + "n" * 150 + ".json", b"{}"), ("frames/b.jpg", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    rows = tar.read_tar(spark, str(tmp_path / "x.tar"), prefix="frames/").orderBy("name").collect()
    assert [(r.name, r.size, bytes(r.data)) for r in rows] == [("frames/a.jpg", 700, b"1" * 700), ("frames/b.jpg", 0, b"")]
    index = tar.read_tar(spark, str(tmp_path / "x.tar"), index_only=True).collect()
    assert len(index) == 3 and all(r.data is None for r in index) and any(len(r.name) > 150 for r in index)


def test_cache_put(spark, tmp_path):
    cache = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "key string, vector array<double>")
    out = files.cache_put(cache, spark.createDataFrame([("b", [3.0]), ("c", [4.0])], "key string, vector array<double>"), str(tmp_path / "cache"))
    assert {r.key: r.vector for r in out.collect()} == {"a": [1.0], "b": [3.0], "c": [4.0]}
    calls = []
    requests = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    have = spark.createDataFrame([(hashlib.sha1(b"x").hexdigest(), [0.5])], "key string, vector array<double>")
    both, fresh = scoring.embedded(requests, lambda texts: [[float(len(t))] for t in texts], have, batch=1)
    assert {r.text: r.vector for r in both.collect()} == {"x": [0.5], "y": [1.0]} and fresh.count() == 1 and not calls


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "x.tar"
    with tarfile.open(path, "w", format=tarfile.GNU_FORMAT) as t:
        names = [f"r/eye_tracking/{k}.jpg" for k in range(30)] + ["r/audio/anonymized.wav", "r/audio/transcript.txt"] + [f"r/picture/{'n' * 120}{k}.jpg" for k in range(10)] + ["r/gaze.csv"]
        for k, name in enumerate(names):
            info = tarfile.TarInfo(name)
            info.size = 200_000 if name.endswith(".jpg") else 700 + k
            t.addfile(info, io.BytesIO(bytes([k % 251]) * info.size))
    return path


class Counting(ranges.FileRange):
    def __init__(self, path):
        super().__init__(path)
        self.bytes = 0

    def read(self, offset, n):
        out = super().read(offset, n)
        self.bytes += len(out)
        return out


def test_headers_are_read_without_the_data(archive):
    source = Counting(str(archive))
    with tarfile.open(archive) as t:
        want = [(m.name, m.size, m.offset_data) for m in t.getmembers()]
    assert [(n, s, o) for n, s, _, o in tar.members(source, window=4096)] == want
    assert source.bytes < source.size / 10
    tail = tar.tail_members(source, 300_000)
    assert [m[0] for m in tail][-1] == "r/gaze.csv" and set((n, s, o) for n, s, _, o in tail) <= set(want)
    found = tar.sections(source, lambda n: "eye_tracking/" in n, {"wav": "audio/anonymized.wav", "transcript": "audio/transcript.txt"}, 1 << 20)
    assert {k: (m[0], m[1], m[3]) for k, m in found.items()} == {"wav": want[30], "transcript": want[31]}
    assert tar.transcript_of(source) == bytes([31]).decode() * 731


def test_members_over_http(spark, archive):
    raw, state = archive.read_bytes(), {"fail": 2, "short": 1, "reads": 0}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()

        def do_GET(self):
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            state["reads"] += 1
            part = raw[a : b + 1]
            if state["fail"]:
                state["fail"] -= 1
                self.send_response(503)
                self.end_headers()
                return
            if state["short"]:
                state["short"] -= 1
                part = part[:-1]
            self.send_response(206)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, waits = f"http://127.0.0.1:{server.server_port}", []
    try:
        source = ranges.HttpRange(f"{url}/x.tar", "t", wait=waits.append)
        assert source.read(1000, 50) == raw[1000:1050] and waits == [1, 2, 4] and source.read(len(raw) - 5, 50) == raw[-5:] and source.read(len(raw), 5) == b""
        state["fail"] = 99
        with pytest.raises(OSError, match="could not be read"):
            source.read(0, 5)
        state["fail"] = 0
        assert isinstance(ranges.open_source("x.tar", mount=str(archive.parent)), ranges.FileRange)
        assert isinstance(ranges.open_source("x.tar", mount="/nowhere", base_url=url), ranges.HttpRange)
        listed = spark.createDataFrame([("x.tar",)], "archive string")
        got = tar.scan(listed, suffix="gaze.csv", base_url=url).collect()
        assert [(r.name, bytes(r.data)) for r in got] == [("r/gaze.csv", bytes([42]) * 742)]
    finally:
        server.shutdown()


def test_members_are_read_again_by_offset(spark, archive):
    index = tar.read_tar(spark, str(archive), index_only=True)
    assert index.count() == 43 and index.filter("data is not null").count() == 0
    got = tar.read_members(index.filter("name like '%transcript.txt'")).collect()
    assert [(r.name, bytes(r.data)) for r in got] == [("r/audio/transcript.txt", bytes([31]) * 731)]


def test_clip_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "clip_0001.tar", "w") as t:
        for name, data in (("frames/b.jpg", b"2"), ("meta.json", b'{"clip": 1}'), ("frames/a.jpg", b"1"), ("frames/x.txt", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    r = tar.clip_archives(spark, str(tmp_path / "clip_0001.tar")).first()
    assert r.meta == '{"clip": 1}' and [(f.name, bytes(f.data)) for f in r.frames] == [("a.jpg", b"1"), ("b.jpg", b"2")]


def test_seeded_samples():
    got = timeline.seeded_positions({"a": (50, 90, 7), "b": (50, 50, 3), "c": (0, 4, 9)})
    rng = random.Random(42)
    assert got == [("a", p) for p in sorted(rng.sample(list(range(50, 90)), 7))] + [("c", p) for p in sorted(rng.sample(list(range(4)), 4))]
    taken = timeline.shuffled_take({"b": 10, "a": 10, "c": 1}, 8)
    assert [g for g, _ in taken] == ["a"] * 3 + ["b"] * 3 + ["c"] and len(set(taken)) == 7


def test_replies_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        chunk = '{"candidates":[{"content":{"parts":[{"text":"%s"}]}}],"usageMetadata":{"candidatesTokenCount":%d}}'
        (tmp_path / "in" / f"r{k}.sse").write_text("\n".join("data: " + chunk % (x, k) for x in ("a", "b")))
    stream = files.replies(files.chunks_of(incremental.arriving_replies(spark, str(tmp_path / "in"), 1)))
    incremental.run_to_table(stream, "replies_t", str(tmp_path / "cp")).awaitTermination()
    batch = files.replies(files.reply_chunks(spark, str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("replies_t").collect())) == sorted(map(tuple, batch.collect())) and batch.first().payload == "ab"


def test_stream_equals_batch(spark, tmp_path):
    clips = spark.range(100).select((F.col("id") % 7).alias("rec"), (F.col("id") % 40).alias("clip"), (F.col("id") % 3 > 0).alias("ok"), (F.col("id") % 40 / 4).alias("cost"))
    clips.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = incremental.arriving(spark, str(tmp_path / "in"), clips.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), 1)
    args = (["rec", "clip"], ["rec"], F.col("cost"), F.lit(True))
    q = incremental.run_to_table(incremental.totals(stream, *args), "totals_t", str(tmp_path / "cp"))
    q.awaitTermination()
    batch = incremental.totals(clips, *args)
    assert sorted(map(tuple, spark.table("totals_t").collect())) == sorted(map(tuple, batch.collect()))
    total = batch.agg(F.sum("cost")).first()[0]
    assert incremental.gate(batch, total).first()["stop"] and not incremental.gate(batch, total + 1).first()["stop"]
