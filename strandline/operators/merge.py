"""Merging clips into recordings and recordings into days, with their text forms and reports.

A clip is (recording, clip_id, ok, clip_start, clip_end, has_gaze, model, tokens_in, tokens_out,
tokens_think, parsed), and parsed a struct (scene_summary, activity_chain, segments); a segment has
time_range, action, environment, speech, text_visible, objects and details. One recording, or one
day of them, is a row whose arrays hold its clips and segments: hours of video, not the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import unicode_count
from strandline.operators import captions
from strandline.operators.redact import MERGE_AUDIT

REPORT = ("recording", "date", "clip_count", "clip_ok", "clip_failed", "failed_clip_ids", "segment_count", "time_start", "time_end", "has_gaze", "model", "tokens", "est_cost_usd", "pii_audit")


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _clock(c: Column) -> Column:
    return F.coalesce(F.substring(c, 12, 8), F.lit(""))


def pii_counts(blob: Column, schools: str | None = None) -> Column:
    """Hits of each pattern in a serialised text, and their total without the placeholders; ``schools`` is the pattern of plain school names."""
    patterns = [*([("school_plain", f"(?i){schools}")] if schools else []), *MERGE_AUDIT]
    counts = {name: unicode_count(blob, p) for name, p in patterns}
    total = sum((c for name, c in counts.items() if name != "anonymized_placeholders"), F.lit(0))
    return F.struct(*[c.cast("long").alias(name) for name, c in counts.items()], total.cast("long").alias("total_hits"))


def pii_audit(df: DataFrame, by: Sequence[str], value: str, schools: str | None = None) -> DataFrame:
    """Sums of the hits over each group's serialised values."""
    rows = df.select(*by, pii_counts(F.col(value), schools).alias("h"))
    return rows.groupBy(*by).agg(*[F.sum(f"h.{n}").alias(n) for n in rows.schema["h"].dataType.names])


def merged_recordings(clips: DataFrame, schools: str | None = None) -> DataFrame:
    """One row per recording: counts, times by the clips' order, tokens, cost, audit, summaries and segments in order of clip and start."""
    fine = captions.ok_truthy(F.col("ok"))
    base = F.coalesce(F.nullif(_clock(F.col("clip_start")), F.lit("")), F.lit("00:00:00"))
    first_clock = lambda s: F.regexp_extract(F.coalesce(s["time_range"], F.lit("")), r"(\d{1,2}:\d{2}:\d{2})", 1)
    own = F.coalesce("parsed.segments", F.array().cast(clips.schema["parsed"].dataType["segments"].dataType))
    placed = F.transform(own, lambda s, i: F.struct(F.col("clip_id").alias("clip_id"), F.coalesce(F.nullif(first_clock(s), F.lit("")), base).alias("sort"), i.alias("i"), s.alias("segment")))
    summary = F.struct(
        "clip_id", F.concat(_clock(F.col("clip_start")), F.lit("–"), _clock(F.col("clip_end"))).alias("time"), fine.alias("ok"),
        F.coalesce("parsed.scene_summary", F.lit("")).alias("summary"), F.coalesce("parsed.activity_chain", F.lit("")).alias("activity_chain"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out_tokens = zero(F.col("tokens_out")) + zero(F.col("tokens_think"))
    rows = clips.withColumn("_segments", placed).withColumn("_summary", summary)
    groups = rows.groupBy("recording").agg(
        F.count(F.lit(1)).alias("clip_count"), F.count_if(fine).alias("clip_ok"), F.count_if(~fine).alias("clip_failed"),
        F.sort_array(F.collect_list(F.when(~fine, F.col("clip_id")))).alias("failed_clip_ids"),
        F.min_by("clip_start", "clip_id").alias("time_start"), F.max_by("clip_end", "clip_id").alias("time_end"),
        F.coalesce(F.min_by("has_gaze", "clip_id"), F.lit(False)).alias("has_gaze"), F.min_by("model", "clip_id").alias("model"),
        F.struct(F.sum(zero(F.col("tokens_in"))).alias("in"), F.sum(out_tokens).alias("out_billable")).alias("tokens"),
        F.sort_array(F.collect_list("_summary")).alias("clip_summaries"), F.sort_array(F.flatten(F.collect_list("_segments"))).alias("_segments"),
    )
    segments = F.transform("_segments", lambda s: F.struct(s["clip_id"].alias("clip_id"), s["segment"].alias("segment")))
    done = groups.withColumn("segments", segments).withColumn("date", F.coalesce(F.substring("time_start", 1, 10), F.lit(""))).withColumn("segment_count", F.size("segments"))
    done = done.withColumn("est_cost_usd", captions.cost(F.col("tokens.in"), F.col("tokens.out_billable"), F.lit(0)))
    return done.withColumn("pii_audit", pii_counts(F.to_json("segments"), schools)).select(*REPORT, "clip_summaries", "segments")


def _segment_lines(s: Column, whole: bool = True) -> Column:
    """The text lines of a segment: its action and, where there are any, speech, surroundings, texts, objects and details."""
    line = lambda label, value: F.when(_said(value), F.concat(F.lit(f"       {label}: "), value))
    listed = lambda c: F.array_join(c, ", ")
    head = F.concat(F.lit("   ["), F.coalesce(s["time_range"], F.lit("")), F.lit("] "), F.coalesce(s["action"], F.lit("")))
    more = [line("环境", s["environment"]), line("文字", listed(s["text_visible"])), line("物体", listed(s["objects"])), line("细节", s["details"])] if whole else []
    return F.array_compact(F.array(head, line("语音", s["speech"]), *more))


def recording_text(merged: DataFrame) -> DataFrame:
    """recording, text: the readable form of merged recordings."""
    yes = F.when(F.col("has_gaze"), "有").otherwise("无")
    number = lambda c: F.col(c).cast("string")
    head = F.array(
        F.concat(F.lit("# "), "recording"),
        F.concat(F.lit("日期 "), "date", F.lit("   "), "time_start", F.lit(" → "), "time_end"),
        F.concat(F.lit("clip "), number("clip_ok"), F.lit("/"), number("clip_count"), F.lit(" 成功   segments "), number("segment_count"), F.lit("   眼动 "), yes, F.lit("   模型 "), F.coalesce("model", F.lit(""))),
        F.lit(""),
    )

    def of_clip(c: Column) -> Column:
        own = F.flatten(F.transform(F.filter("segments", lambda s: s["clip_id"] == c["clip_id"]), lambda s: _segment_lines(s["segment"])))
        title = F.concat(F.lit("── clip_"), F.lpad(c["clip_id"].cast("string"), 4, "0"), F.lit("  "), c["time"], F.lit("  "), F.when(c["ok"], "").otherwise("[FAILED]"))
        summary = F.when(_said(c["summary"]), F.concat(F.lit("   « "), c["summary"], F.lit(" »")))
        return F.concat(F.array_compact(F.array(title, summary)), own, F.array(F.lit("")))

    return merged.select("recording", F.array_join(F.concat(head, F.flatten(F.transform("clip_summaries", of_clip))), "\n").alias("text"))


def merged_days(merged: DataFrame) -> DataFrame:
    """One row per date: its recordings in order of start (unreadable starts first), totals, and all segments."""
    start = F.try_to_timestamp("time_start", F.lit("yyyy-MM-dd HH:mm:ss"))
    one = F.struct(start.alias("at"), F.col("recording").alias("recording"), F.struct("recording", F.col("time_start").alias("start"), F.col("time_end").alias("end"), F.col("clip_count").alias("clips"), F.col("segment_count").alias("segments"), "has_gaze").alias("entry"), F.col("segments").alias("found"))
    rows = merged.groupBy("date").agg(
        F.sort_array(F.collect_list(one)).alias("_all"), F.sum("clip_ok").alias("clip_ok"), F.sum("clip_count").alias("clip_count"), F.round(F.sum("est_cost_usd"), 4).alias("est_cost_usd")
    )
    found = F.flatten(F.transform("_all", lambda m: F.transform(m["found"], lambda s: F.struct(m["recording"].alias("recording"), s["clip_id"].alias("clip_id"), s["segment"].alias("segment")))))
    out = rows.withColumn("recordings", F.transform("_all", lambda m: m["entry"])).withColumn("segments", found)
    return out.select("date", "recordings", F.size("recordings").alias("recording_count"), F.size("segments").alias("segment_count"), "clip_ok", "clip_count", "est_cost_usd", "segments")


def day_text(days: DataFrame) -> DataFrame:
    """date, text: the readable form of merged days, with a heading wherever the recording changes."""
    number = lambda c: F.col(c).cast("string")
    head = F.array(
        F.concat(F.lit("# "), "date", F.lit(" 全天 caption")),
        F.concat(number("recording_count"), F.lit(" 条录制   clip "), number("clip_ok"), F.lit("/"), number("clip_count"), F.lit("   segments "), number("segment_count")),
        F.lit(""),
    )
    listed = F.transform("recordings", lambda r: F.concat(F.lit("  · "), r["recording"], F.lit("  "), _clock(r["start"]), F.lit("→"), _clock(r["end"]), F.lit("  "), r["segments"].cast("string"), F.lit(" segs  眼动"), F.when(r["has_gaze"], "有").otherwise("无")))

    def of_segment(s: Column, i: Column) -> Column:
        before = F.get("segments", i - 1)["recording"]
        title = F.when((i == 0) | (before != s["recording"]), F.concat(F.lit("\n══ "), s["recording"]))
        return F.concat(F.array_compact(F.array(title)), _segment_lines(s["segment"], False))

    return days.select("date", F.array_join(F.concat(head, listed, F.array(F.lit("")), F.flatten(F.transform("segments", of_segment))), "\n").alias("text"))


def write_recordings(merged: DataFrame, path: str) -> None:
    """Whole recordings, segments, text and report, each partitioned by recording; a path that exists is refused."""
    segments = merged.select("recording", F.explode("segments").alias("s")).select("recording", "s.clip_id", "s.segment.*")
    parts = {"captions_full": merged, "segments": segments, "report": merged.select(*REPORT)}
    for name, df in parts.items():
        df.write.mode("errorifexists").partitionBy("recording").json(f"{path}/{name}")
    recording_text(merged).write.mode("errorifexists").partitionBy("recording").text(f"{path}/text")


def write_days(days: DataFrame, path: str) -> None:
    """Whole days, segments and text, each partitioned by date; a path that exists is refused."""
    days.write.mode("errorifexists").partitionBy("date").json(f"{path}/day")
    days.select("date", F.explode("segments").alias("s")).select("date", "s.recording", "s.clip_id", "s.segment.*").write.mode("errorifexists").partitionBy("date").json(f"{path}/segments")
    day_text(days).write.mode("errorifexists").partitionBy("date").text(f"{path}/text")
