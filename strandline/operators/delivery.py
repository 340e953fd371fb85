"""Delivery of caption files: kept records, masked values and names, text blocks, audit and index.

Records are JSON of any shape, so their values are walked in Python, an Arrow batch at a
time; which names a record has to hide is found by joins, so the names of the whole corpus
are never gathered in one place.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import redact
from strandline.operators.redact import MASK

# Keys whose strings are names, hold the speech of persons, or repeat raw content.
NAME_KEYS = ("speaker", "name", "participant", "participant_id", "author", "sender", "recipient", "contact_name", "account_name")
SPEECH_KEYS = ("speech", "speech_summary", "transcript", "dialogue", "conversation", "speaker_turns")
RAW_KEYS = ("content_raw",)
_RULES = [(c, re.compile(p), new.replace("$1", r"\g<1>")) for c, p, new in redact.DELIVERY_RULES]
_PREFIX = re.compile(redact.SPEAKER_PREFIX)
_ATTRIBUTED = [re.compile(p) for p in (redact.ATTRIBUTED, redact.ATTRIBUTED_ENGLISH)]
_NAME = re.compile(r"[A-Za-z][A-Za-z .'-]{1,79}")


def _is_person(value: str) -> bool:
    low = value.casefold()
    return bool(_NAME.fullmatch(value)) and low not in redact.NON_PERSON and hashlib.sha256(low.encode()).hexdigest()[:12] not in redact.NON_PERSON_HASHES


def _strings(value: object, key: str = "") -> Iterator[tuple[str, str]]:
    """Every string of a JSON value with the nearest key above it, in lower case."""
    if isinstance(value, str):
        yield key, value
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v, key)
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from _strings(v, str(k).lower())


def record_names(record: object) -> tuple[set[str], set[str]]:
    """Names that a record signals, and those of them that are sure enough to hide in other records."""
    sure, prefixed = set(), set()
    for key, text in _strings(record):
        if key in NAME_KEYS and _is_person(text.strip()):
            sure.add(text.strip())
        for pattern in _ATTRIBUTED:
            sure.update(n for n in pattern.findall(text) if _is_person(n))
        if key in SPEECH_KEYS:
            prefixed.update(n for n in _PREFIX.findall(text) if n.casefold() not in redact.NON_PERSON)
    return sure | prefixed, sure


class _Cleaner:
    def __init__(self, names: list[str]):
        self.hits: dict[str, int] = {}
        ordered = sorted(set(names), key=lambda n: (-len(n), n.casefold()))
        self.names = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(map(re.escape, ordered))})(?![A-Za-z])", re.I) if ordered else None

    def _count(self, category: str, n: int) -> None:
        if n:
            self.hits[category] = self.hits.get(category, 0) + n

    def text(self, text: str) -> str:
        for category, pattern, new in _RULES:
            text, n = pattern.subn(new, text)
            self._count(category, n)
        if self.names:
            text, n = self.names.subn(MASK, text)
            self._count("person_name_in_text", n)
        return text

    def value(self, value: object, key: str = "") -> object:
        """Strings masked; those of list elements have no key of their own."""
        if isinstance(value, dict):
            return {k: self.value(v, str(k).lower()) for k, v in value.items()}
        if isinstance(value, list):
            return [self.value(v) for v in value]
        if not isinstance(value, str):
            return value
        special = "raw_duplicate_removed" if key in RAW_KEYS else "person_name" if key in NAME_KEYS else None
        if special is None:
            return self.text(value)
        self._count(special, 1)
        return MASK


def sanitised(record: object, names: list[str] | None = None) -> tuple[object, dict[str, int]]:
    """A record with its sensitive values masked, and the hits by category; without names, its own are hidden."""
    cleaner = _Cleaner(sorted(record_names(record)[0]) if names is None else names)
    return cleaner.value(record), cleaner.hits


_NAMES = T.ArrayType(T.StringType())
_READ = T.StructType().add("state", T.StringType()).add("clip_id", T.LongType()).add("segments", T.IntegerType()).add("model", T.StringType()).add("own", _NAMES).add("sure", _NAMES).add("text", T.StringType())
_CLEAN = T.StructType().add("line", T.StringType()).add("hits", T.ArrayType(T.StructType().add("category", T.StringType()).add("n", T.IntegerType())))


def _read(line: str) -> tuple:
    try:
        record = json.loads(line)
    except ValueError:
        return "bad", None, 0, None, [], [], ""
    if not isinstance(record, dict) or record.get("ok") is not True:
        return "failed", None, 0, None, [], [], ""
    clip, model = record.get("clip_id"), record.get("model")
    body = record.get("merged") or record.get("parsed")
    segments = body.get("segments") if isinstance(body, dict) else None
    own, sure = record_names(record)
    number = int(clip) if isinstance(clip, int) else None
    return "kept", number, len(segments) if isinstance(segments, list) else 0, model if isinstance(model, str) and model else None, sorted(own), sorted(sure), "\n".join(t for _, t in _strings(record))


@F.pandas_udf(_READ)
def _records(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(x or "") for x in lines], columns=_READ.names).astype({"clip_id": "Int64", "segments": "int32"})


@F.pandas_udf(_CLEAN)
def _cleaned(lines: pd.Series, names: pd.Series) -> pd.DataFrame:
    out = []
    for line, found in zip(lines, names, strict=True):
        clean, hits = sanitised(json.loads(line), list(found))
        out.append((json.dumps(clean, ensure_ascii=False, separators=(",", ":")), [{"category": c, "n": n} for c, n in hits.items()]))
    return pd.DataFrame(out, columns=["line", "hits"])


def read_records(lines: DataFrame) -> DataFrame:
    """(recording, rel, line_no, line) -> also state (kept, failed or bad), clip_id, segments, model, own and sure names, and the text of all values."""
    return lines.withColumn("r", _records("line")).select(*lines.columns, "r.*")


def corpus_names(records: DataFrame) -> DataFrame:
    return records.filter("state = 'kept'").select(F.explode("sure").alias("name")).distinct()


def with_all_names(records: DataFrame, names: DataFrame) -> DataFrame:
    """Kept records with the column ``names``: their own, and those of the corpus that occur in any of their values."""
    kept = records.filter("state = 'kept'").withColumnRenamed("own", "names")
    return redact.with_names(kept, "text", names)


def delivered_records(records: DataFrame, names: DataFrame) -> DataFrame:
    """Kept records, masked, with their hits."""
    rows = with_all_names(records, names)
    return rows.withColumn("c", _cleaned("line", "names")).select("recording", "rel", "line_no", "clip_id", "names", F.col("c.line").alias("line"), F.col("c.hits").alias("hits"))


def delivered_text(lines: DataFrame, records: DataFrame, names: DataFrame) -> DataFrame:
    """Text lines (recording, rel, line_no, line) of kept clips' blocks, masked by rules and by the names of the corpus and of the block's clip."""
    kept = records.filter("state = 'kept' and clip_id is not null").groupBy("recording", "clip_id").agg(F.max_by("own", "line_no").alias("clip_names"))
    by, known = ["recording", "rel"], records.select("recording").distinct()
    mine = lines.join(known, "recording", "left_semi")
    ids = mine.select(*by).distinct().join(kept.select("recording", "clip_id"), "recording")
    blocks = redact.clip_blocks(mine, by, "line_no", "line", ids).unionByName(redact.clip_blocks(lines.join(known, "recording", "left_anti"), by, "line_no", "line"))
    # a name may stand in a part that a rule masks, so names are looked for in what the rules leave
    clean = redact.masked(blocks, "line").join(kept, ["recording", "clip_id"], "left")
    found = redact.with_names(clean.withColumn("names", F.coalesce("clip_names", F.array().cast("array<string>"))), "line", names)
    n = redact.names_hits(F.col("line"), F.col("names"))
    named = F.when(n > 0, F.array(F.struct(F.lit("person_name_in_text").alias("category"), n.alias("n")))).otherwise(F.array().cast("array<struct<category:string,n:int>>"))
    out = found.select("recording", "rel", "line_no", F.regexp_replace(redact.mask_names(F.col("line"), F.col("names")), r"(?U)\s+$", "").alias("line"), F.concat("hits", named).alias("hits"))
    return redact.trimmed_end(out, ["recording", "rel"], "line_no", "line")


def record_stats(records: DataFrame) -> DataFrame:
    """Per recording: lines, kept, failed and bad ones, segments, and the models' counts."""
    state = lambda s: F.count_if(F.col("state") == s)
    totals = records.groupBy("recording").agg(F.max("line_no").alias("lines"), state("kept").alias("kept"), state("failed").alias("filtered_failed"), state("bad").alias("parse_errors"), F.sum(F.when(F.col("state") == "kept", F.col("segments")).otherwise(0)).alias("segments"))
    each = records.filter("state = 'kept' and model is not null").groupBy("recording", "model").count()
    models = each.groupBy("recording").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "count")))).alias("models"))
    return totals.join(models, "recording", "left")


def _share(a, b):
    return F.when(b > 0, F.round(a / b, 3))


def recomputed_index(index: DataFrame, stats: DataFrame) -> DataFrame:
    """The index (recording, usable_clips, target_clips, in_first_100h) with the counts of what was delivered; recordings without records stay as they are."""
    rows = index.join(stats, "recording", "left")
    new = F.col("lines").isNotNull()
    pick = lambda fresh, old: F.when(new, fresh).otherwise(old)
    return rows.select(
        "recording",
        pick(F.col("kept"), F.col("usable_clips")).cast("long").alias("usable_clips"),
        pick(F.col("lines"), F.col("target_clips")).cast("long").alias("target_clips"),
        pick(F.col("target_clips"), F.lit(None)).cast("long").alias("source_planned_target_clips"),
        pick(F.col("lines"), F.lit(None)).cast("long").alias("selected_candidate_clips"),
        F.when(new, _share(F.col("kept"), F.col("lines"))).alias("coverage"),
        "segments",
        "models",
        "in_first_100h",
    )


def index_summary(index: DataFrame) -> DataFrame:
    """One row of totals over a recomputed index."""
    rows = index.filter("usable_clips is not null")
    first = F.coalesce(F.col("in_first_100h"), F.lit(False))
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    sums = rows.agg(
        total("usable_clips").alias("usable_clips_total"),
        total("selected_candidate_clips").alias("selected_candidate_clips_total"),
        total("usable_clips", first).alias("first_100h_usable"),
        total("selected_candidate_clips", first).alias("first_100h_target"),
        total("source_planned_target_clips", first).alias("source_planned_target_clips"),
        F.count_if(F.col("usable_clips") > 0).alias("recordings_with_output"),
    )
    return sums.select(
        "*",
        _share(F.col("usable_clips_total"), F.col("selected_candidate_clips_total")).alias("selected_candidate_coverage"),
        (F.col("selected_candidate_clips_total") - F.col("usable_clips_total")).alias("filtered_or_unparseable_clips_total"),
        _share(F.col("first_100h_usable"), F.col("first_100h_target")).alias("first_100h_coverage"),
    )


def archived_index(index: DataFrame, stats: DataFrame) -> DataFrame:
    """The second version's index: every recording recounted, coverage against the planned target and 0 without one."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    usable = zero(F.col("kept"))
    target = F.coalesce(F.col("target_clips"), usable)
    rows = index.select("recording", "target_clips", "in_first_100h").join(stats, "recording", "left")
    coverage = F.when(target > 0, F.round(usable / target, 3)).otherwise(0.0)
    return rows.select("recording", usable.alias("usable_clips"), "target_clips", zero(F.col("segments")).alias("segments"), zero(F.col("filtered_failed")).alias("filtered_failed_clips"), coverage.alias("coverage"), "in_first_100h")


def deliver(records: DataFrame, texts: DataFrame, index: DataFrame) -> dict[str, DataFrame]:
    """All that a delivery consists of: records, text, audit, audit_locations, stats, index and summary."""
    read = read_records(records)
    names = corpus_names(read)
    one, two = delivered_records(read, names), delivered_text(texts, read, names)
    hits = one.select("rel", "line_no", "hits").unionByName(two.select("rel", "line_no", "hits"))
    stats = record_stats(read)
    fresh = recomputed_index(index, stats)
    return {"records": one, "text": two, "audit": redact.audit(hits, "rel", "line_no"), "audit_locations": redact.audit_locations(hits, "rel", "line_no"), "stats": stats, "index": fresh, "summary": index_summary(fresh)}


def write_delivery(parts: dict[str, DataFrame], path: str) -> None:
    """Each part under ``path``, lines partitioned by recording; a path that exists is refused."""
    for name in ("records", "text"):
        parts[name].select("recording", "line_no", F.col("line").alias("value")).repartition("recording").sortWithinPartitions("recording", "line_no").select("recording", "value").write.mode("errorifexists").partitionBy("recording").text(f"{path}/{name}")
    for name in ("audit", "audit_locations", "stats", "index", "summary"):
        parts[name].write.mode("errorifexists").json(f"{path}/{name}")


def copied_files(spark: SparkSession, source: str, target: str, leave: tuple[str, ...] = ("captions.jsonl", "captions.txt", "index.json")) -> DataFrame:
    """Copies all files below a folder but those of the given names, each by the task that holds its path: (rel, length) of what was copied."""
    from strandline.session import ship

    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "length")
    root = source.rstrip("/") + "/"
    rel = F.substring_index("path", root, -1)
    rows = found.select("path", "length", rel.alias("rel")).filter(~F.regexp_extract("path", "([^/]*)$", 1).isin(*leave))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def place(path: str) -> tuple[fs.FileSystem, str]:
            return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

        for batch in batches:
            for path, name in zip(batch.column("path").to_pylist(), batch.column("rel").to_pylist(), strict=True):
                (system, at), (other, to) = place(path), place(f"{target.rstrip('/')}/{name}")
                other.create_dir(to.rsplit("/", 1)[0])
                with system.open_input_stream(at) as read, other.open_output_stream(to) as write:
                    while part := read.read(1 << 20):
                        write.write(part)
            yield pa.RecordBatch.from_arrays([batch.column("rel"), batch.column("length")], ["rel", "length"])

    return rows.mapInArrow(copy, "rel string, length long")
