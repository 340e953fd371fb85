"""Text functions as Column expressions: timestamps, names, lists, prompts.

Patterns avoid engine-specific classes where Python and Java differ: ``strip``
uses Unicode blanks, and no pattern relies on verbose mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of event lines, recordings and frames.
EVENT_PREFIX = r"^\[\d{2}:\d{2}:\d{2} -> \d{2}:\d{2}:\d{2}\]\s*"
DATED_EVENT_PREFIX = r"^\[\d{2}-\d{2} \d{2}:\d{2}:\d{2} -> \d{2}-\d{2} \d{2}:\d{2}:\d{2}\]\s*"
EVENT_LINE = r"^\[(\d{2}:\d{2}:\d{2}) -> (\d{2}:\d{2}:\d{2})\]\s*(.*)$"
RECORDING = r"^(\d+)-(\d+)_hkt(\d{2})(\d{2})-(\d{2})(\d{2})_(\d+)m_(.+)$"
LIST_ITEM = r"^\s*(\d+)[.)\]、]\s*(.*)$"
REJECTED_STARTS = ("We ", "Need ", "This ")
FRAME = r"(?i)(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})_[A-Z]{2,4}__frame_(\d+)\.(?:jpg|jpeg|png|txt)$"
TRANSCRIPT = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?: [A-Z]{2,4})? -> (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})(?: [A-Z]{2,4})?\]"
OFFSET_TRANSCRIPT = r"^\[(\d{1,2}):(\d{2})(?::(\d{2}))?\s*[-–—]\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\]"
OFFSET_DAY = "2000-01-01 00:00:00"
RECOGNISED_META = ("capture_time", "capture_epoch", "frame_index")
CLIP_CONTEXT = """## Scene: 30-second first-person video clip
- Date: {day}
- Absolute time range: {start} to {end} HKT
- Frame count: {n} frames at 1fps
- Frame timestamps: {first} to {last} HKT
- IMPORTANT: Use these absolute HKT timestamps (HH:MM:SS format) for all time_range fields

## Audio Transcript
{transcript}

## OCR-detected Text (per-frame, with HKT timestamps)
{block}

## Video Frames (all {n} frames, 1 second apart, chronologically ordered)"""


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def unicode_count(c: Column, pattern: str) -> Column:
    """Hits of a pattern whose classes are those of all scripts."""
    return F.regexp_count(c, F.lit("(?U)" + pattern))


def strip_timestamps(line: Column) -> Column:
    """Both anchored time prefixes go; a prefix with only its start dated stays, as it matches neither."""
    return F.regexp_replace(F.regexp_replace(line, DATED_EVENT_PREFIX, ""), EVENT_PREFIX, "")


def time_range(c: Column) -> Column:
    """Start and end around the first dash of either kind; nulls without a dash."""
    part = lambda k: F.when(c.rlike("[–-]"), strip(F.regexp_extract(strip(c), "(?s)^(.*?)[–-](.*)$", k)))
    return F.struct(part(1).alias("start"), part(2).alias("end"))


def event_fields(line: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(line, EVENT_LINE, k), F.lit(""))
    return F.struct(part(1).alias("start"), part(2).alias("end"), F.regexp_extract(line, EVENT_LINE, 3).alias("action"))


def recording_key(name: Column) -> Column:
    """(month, day, hour, minute); names of another form sort last."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(name, RECORDING, k), F.lit("")).cast("int"), F.lit(99))
    return F.struct(part(1).alias("month"), part(2).alias("day"), part(3).alias("hour"), part(4).alias("minute"))


def recording_fields(name: Column) -> Column:
    """Date, start, end, minutes and id; names of another form give 00-00 and ??:??."""
    part = lambda k: F.nullif(F.regexp_extract(name, RECORDING, k), F.lit(""))
    fits = F.coalesce(name.rlike(RECORDING), F.lit(False))
    return F.struct(
        F.when(fits, F.concat_ws("-", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))).otherwise("00-00").alias("date"),
        F.when(fits, F.concat_ws(":", part(3), part(4))).otherwise("??:??").alias("start"),
        F.when(fits, F.concat_ws(":", part(5), part(6))).otherwise("??:??").alias("end"),
        part(7).cast("int").alias("minutes"),
        part(8).alias("uuid"),
    )


def recording_day(name: Column, year: int) -> Column:
    """ISO day of a recording's name, which has no year; "9999", behind all days, for other names."""
    part = lambda k: F.lpad(F.regexp_extract(name, r"^(\d+)-(\d+)_", k), 2, "0")
    return F.when(name.rlike(r"^\d+-\d+_"), F.concat_ws("-", F.lit(str(year)), part(1), part(2))).otherwise("9999")


def _clock_seconds(c: Column, pattern: str, first: int) -> Column:
    h, m, s = (F.nullif(F.regexp_extract(c, pattern, first + k), F.lit("")).cast("int") for k in range(3))
    return h * 3600 + m * 60 + F.coalesce(s, F.lit(0))


def seconds_of(clock: Column) -> Column:
    """Seconds of a clock at the beginning, h:mm:ss; null otherwise."""
    return _clock_seconds(clock, r"^(\d{1,2}):(\d{2}):(\d{2})", 1)


def segment_span(c: Column, missing: int = 3) -> Column:
    """(start, end) in seconds of two clocks; after a first one alone the end is ``missing`` later; else null."""
    text = strip(c)
    both = r"^(\d{1,2}):(\d{2}):(\d{2})\s*[–\-~]\s*(\d{1,2}):(\d{2}):(\d{2})"
    start = seconds_of(text)
    return F.when(start.isNotNull(), F.struct(start.alias("start"), F.coalesce(_clock_seconds(text, both, 4), start + missing).alias("end")))


def played_span(c: Column, base: Column, missing: float = 30.0) -> Column:
    """(start, end) seconds of a clip: clocks relative to ``base``, or offsets like 0s-5s; an open end is ``missing``; else null."""
    text = strip(c)
    both = r"^(\d{1,2}):(\d{2}):(\d{2})\s*[–-]\s*(\d{1,2}):(\d{2}):(\d{2})"
    parts = F.split(F.replace(text, F.lit("s"), F.lit("")), "-")
    number = lambda k: strip(F.get(parts, F.lit(k))).try_cast("double")
    start, end = number(0), F.when(F.size(parts) > 1, number(1)).otherwise(F.lit(missing))
    clocks = F.struct((_clock_seconds(text, both, 1) - base).cast("double").alias("start"), (_clock_seconds(text, both, 4) - base).cast("double").alias("end"))
    return F.when(text.rlike(both), clocks).when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def base_seconds(ranges: Column) -> Column:
    """The first clock of an array of ranges, 0 if none has one."""
    return F.coalesce(F.get(F.filter(F.transform(ranges, seconds_of), lambda s: s.isNotNull()), F.lit(0)), F.lit(0))


def frame_fields(name: Column) -> Column:
    """Time, clock and index of a frame's file name; nulls and an empty clock for other names."""
    base = F.regexp_extract(name, "([^/]*)$", 1)
    part = lambda k: F.regexp_extract(base, FRAME, k)
    fits = base.rlike(FRAME)
    clock = F.concat_ws(":", part(2), part(3), part(4))
    return F.struct(
        F.when(fits, F.concat_ws(" ", part(1), clock).try_cast("timestamp_ntz")).alias("time"),
        F.when(fits, clock).otherwise("").alias("clock"),
        F.when(fits, part(5).cast("int")).alias("index"),
    )


def transcript_interval(line: Column) -> Column:
    """(start, end) of a transcript line with dated clocks in any zone, or with offsets, which count from ``OFFSET_DAY``; else null."""
    dated = lambda k: F.regexp_extract(line, TRANSCRIPT, k).try_cast("timestamp_ntz")

    def offset(first: int) -> Column:
        h, m, s = (F.nullif(F.regexp_extract(line, OFFSET_TRANSCRIPT, first + k), F.lit("")).cast("int") for k in range(3))
        return F.timestamp_add("SECOND", h * 3600 + m * 60 + F.coalesce(s, F.lit(0)), F.lit(OFFSET_DAY).cast("timestamp_ntz"))

    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    return F.when(line.rlike(TRANSCRIPT), pair(dated(1), dated(2))).when(line.rlike(OFFSET_TRANSCRIPT), pair(offset(1), offset(4)))


def clean_recognised(text: Column) -> Column:
    """Recognised text without its metadata lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike("^(?:" + "|".join(RECOGNISED_META) + ")"))
    return strip(F.array_join(lines, "\n"))


def numbered_items(raw: Column, most: int = 3) -> Column:
    """Items of a numbered list without a leading time, meta sentences left out, at most ``most``."""
    lines = F.filter(F.transform(F.split(raw, "\n"), strip), lambda x: x.rlike(LIST_ITEM))
    items = F.transform(lines, lambda x: strip(F.regexp_replace(strip(F.regexp_extract(x, LIST_ITEM, 2)), r"^\[[^\]]+\]\s*", "")))
    fine = F.filter(items, lambda x: (x != "") & ~x.rlike("^(?:" + "|".join(REJECTED_STARTS) + ")"))
    return F.slice(fine, 1, most)


def without_leading_bracket(line: Column) -> Column:
    return F.regexp_replace(line, r"^\[[^\]]+\]\s*", "")


def padded(items: Column, size: int = 3) -> Column:
    return F.slice(F.concat(items, F.array_repeat(F.lit(""), size)), 1, size)


def candidate_actions(raw: Column, k: int) -> Column:
    """The first k actions of each candidate of a reply, without times; the reply may be fenced or have prose around it."""
    body = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    parsed = F.coalesce(F.try_parse_json(body), F.try_parse_json(inner))
    found = F.try_variant_get(parsed, "$.candidates", "array<struct<actions:array<variant>>>")
    is_text = lambda a: (F.schema_of_variant(a) == "STRING") & (strip(F.try_variant_get(a, "$", "string")) != "")
    texts = lambda c: F.filter(F.coalesce(c["actions"], F.array().cast("array<variant>")), is_text)
    clean = F.transform(found, lambda c: F.transform(F.slice(texts(c), 1, k), lambda a: strip(strip_timestamps(strip(F.try_variant_get(a, "$", "string"))))))
    return F.coalesce(F.filter(clean, lambda c: F.size(c) > 0), F.array().cast("array<array<string>>"))


def judge_digit(raw: Column) -> Column:
    """A line that is one digit, else the last digit that is a word of its own, else null."""
    line = F.nullif(F.regexp_extract(raw, r"(?m)^\s*([0-9])\s*$", 1), F.lit(""))
    last = F.try_element_at(F.regexp_extract_all(raw, F.lit(r"(?U)(?<!\w)([0-9])(?!\w)"), 1), F.lit(-1))
    return F.coalesce(line, last).cast("int")


def date_prefix(dates: Column) -> Column:
    """How a prompt names days: none for one day, else by the form that all of them share."""
    distinct = F.array_distinct(dates)
    return (
        F.when(F.size(distinct) <= 1, "")
        .when(F.forall(distinct, lambda d: d.rlike(r"^\d{2}-\d{2}$")), "MM-DD ")
        .when(F.forall(distinct, lambda d: d.rlike(r"^day\d+$")), "dayN ")
        .otherwise("DATE ")
    )


def rendered_segments(segments: Column, label: str) -> Column:
    """A numbered line per (date, start, end, n), with the number of events where it is known."""
    def line(s: Column, i: Column) -> Column:
        events = F.when(s["n"].isNotNull(), F.concat(F.lit(" ("), s["n"].cast("string"), F.lit(" events)"))).otherwise("")
        return F.concat(F.lit(f"  {label} "), (i + 1).cast("string"), F.lit(": "), s["date"], F.lit(" "), s["start"], F.lit(" – "), s["end"], events)

    return F.when(F.size(segments) > 0, F.array_join(F.transform(segments, line), "\n")).otherwise(f"  {label} 1: (unknown)")


def point_prompt(template: str, k: int, context: Column, target: Column, lines: Column) -> Column:
    """(system, user) of a point: the template with its sessions, target segments (the first alone for one step) and dates, and the event history."""
    prefix = date_prefix(F.array_union(F.transform(context, lambda s: s["date"]), F.transform(target, lambda s: s["date"])))
    system = filled(
        template,
        k=F.lit(str(k)),
        context_segments=rendered_segments(context, "Session"),
        n_context_segments=F.greatest(F.size(context), F.lit(1)).cast("string"),
        target_segments=rendered_segments(F.slice(target, 1, 1) if k == 1 else target, "Segment"),
        date_prefix=prefix,
        action_example=F.concat(F.lit("["), prefix, F.lit("HH:MM:SS -> "), prefix, F.lit("HH:MM:SS] ")),
    )
    user = F.concat(F.lit("Event history ("), F.size(lines).cast("string"), F.lit(" events, oldest first):\n\n"), F.array_join(lines, "\n"))
    return F.struct(system.alias("system"), user.alias("user"))


def clip_context(start: Column, end: Column, n_frames: Column, first: Column, last: Column, transcript: Column, recognised: Column, most: int = 30_000) -> Column:
    """The text that goes with a clip's frames; recognised text is cut at ``most`` characters."""
    texts = F.when(F.size(recognised) > 0, F.array_join(recognised, "\n")).otherwise("(no text detected)")
    block = F.when(F.char_length(texts) > most, F.concat(F.substring(texts, 1, most), F.lit("\n... (OCR truncated, remaining frames omitted)"))).otherwise(texts)
    day = F.when(start != "", F.substring(start, 1, 10)).otherwise("unknown")
    number = n_frames.cast("string")
    return filled(CLIP_CONTEXT, day=day, start=start, end=end, n=number, first=F.coalesce(first, F.lit("?")), last=F.coalesce(last, F.lit("?")), transcript=transcript, block=block)


def headed_chunks(text: Column) -> Column:
    """(heading, rest) of each part of a text that breaks before "Heading:" behind a full stop."""
    parts = F.transform(F.split(strip(text), r"(?<=[.。])\s+(?=[A-Z一-鿿][^:：]{2,28}[:：])"), strip)
    head = r"(?s)^([^:：]{2,28}[:：])\s*(.*)$"
    fine = F.filter(parts, lambda p: p != "")
    return F.transform(fine, lambda p: F.struct(F.when(p.rlike(head), F.regexp_extract(p, head, 1)).otherwise("").alias("heading"), F.when(p.rlike(head), F.regexp_extract(p, head, 2)).otherwise(p).alias("rest")))


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def endpoint(base: Column, tail: str) -> Column:
    bare = F.regexp_replace(base, "/+$", "")
    return F.when(F.endswith(bare, F.lit(tail)), bare).when(F.endswith(bare, F.lit("/v1")), F.concat(bare, F.lit(tail))).otherwise(F.concat(bare, F.lit("/v1" + tail)))


def crop_box(width: Column, height: Column, x: Column, y: Column, share: float = 0.62, gaze_width: float = 2880.0) -> Column:
    """Square around a gaze point, inside the frame; around the frame's middle if there is no point."""
    whole = lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    side = F.floor(F.least(width, height) * share)
    seen = x.isNotNull() & y.isNotNull()

    def corner(size: Column, at: Column) -> Column:
        centre = F.when(seen, at * size / gaze_width).otherwise(size / 2)
        return F.greatest(F.lit(0), F.least(size - side, whole(centre - side / 2)))

    return F.struct(corner(width, x).alias("left"), corner(height, y).alias("top"), side.alias("side"))


def index_spec(spec: Column) -> Column:
    """Indices of "3", "0-4" or "1,3-5"."""
    def span(p: Column) -> Column:
        low = F.regexp_extract(p, r"^(\d+)", 1).cast("int")
        high = F.coalesce(F.nullif(F.regexp_extract(p, r"-(\d+)$", 1), F.lit("")).cast("int"), low)
        return F.sequence(low, high)

    return F.flatten(F.transform(F.filter(F.split(F.regexp_replace(spec, r"[\[\]\s]", ""), ","), lambda p: p.rlike(r"^\d+(-\d+)?$")), span))
