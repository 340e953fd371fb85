"""Tar archives: a header index, and the members whose names fit.

A task opens its archives as byte ranges. It reads headers through a small window and skips the
data between them, so an index, or a filter on names, costs a fraction of an archive, and no archive
is ever held whole. Members found once can be read again by their offsets, or from the archive's end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.ranges import Source, open_source

BLOCK = 512
WINDOW = 64 << 10
SCHEMA = "archive string, name string, size long, kind string, offset long, data binary"
_TYPES = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
BATCH_BYTES = 32 << 20


def _octal(field: bytes) -> int:
    if field[:1] and field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = field.split(b"\0", 1)[0].strip()
    return int(digits, 8) if digits else 0


def _header(head: bytes) -> tuple[str, int, str] | None:
    """(name, size, kind), or None if it isn't a header."""
    if len(head) < BLOCK or head[257:262] != b"ustar":
        return None
    try:
        size = _octal(head[124:136])
    except ValueError:
        return None
    name = head[:100].split(b"\0", 1)[0].decode("utf-8", "replace")
    prefix = head[345:500].split(b"\0", 1)[0].decode("utf-8", "replace") if head[257:263] == b"ustar\0" else ""
    return f"{prefix}/{name}" if prefix else name, size, chr(head[156]) if head[156] else "0"


class _Window:
    """Reads of a source through a window that moves on when something lies outside it."""

    def __init__(self, source: Source, size: int = WINDOW):
        self.source, self.size, self.at, self.raw = source, size, 0, b""

    def read(self, offset: int, n: int) -> bytes:
        if not (self.at <= offset and offset + n <= self.at + len(self.raw)):
            self.at, self.raw = offset, self.source.read(offset, max(self.size, n))
        return self.raw[offset - self.at : offset - self.at + n]


def members(source: Source, start: int = 0, end: int | None = None, window: int = WINDOW) -> Iterator[tuple[str, int, str, int]]:
    """(name, size, kind, place of the data) with long names resolved, from headers alone; blocks that are no header are stepped over."""
    view, at, long_name = _Window(source, window), start, None
    limit = source.size if end is None else min(end, source.size)
    while at + BLOCK <= limit:
        head = view.read(at, BLOCK)
        at += BLOCK
        found = _header(head)
        if found is None:
            if not head.strip(b"\0"):
                return
            continue
        name, size, kind = found
        data, at = at, at + -(-size // BLOCK) * BLOCK
        if kind == "L":
            long_name = view.read(data, size).split(b"\0", 1)[0].decode("utf-8", "replace")
            continue
        yield long_name or name, size, kind, data
        long_name = None


def _headers_in(raw: bytes, base: int) -> list[tuple[str, int, str, int]]:
    """Members whose headers lie in a piece of an archive that may begin anywhere on a block, long names resolved."""
    out, long_name = [], None
    for at in range(0, len(raw) - BLOCK + 1, BLOCK):
        found = _header(raw[at : at + BLOCK])
        if found is None:
            continue
        name, size, kind = found
        if kind == "L":
            long_name = raw[at + BLOCK : at + BLOCK + size].split(b"\0", 1)[0].decode("utf-8", "replace")
            continue
        out.append((long_name or name, size, kind, base + at + BLOCK))
        long_name = None
    return out


def tail_members(source: Source, n: int = 8 << 20) -> list[tuple[str, int, str, int]]:
    """Members whose headers lie within the last n bytes."""
    base = max(0, source.size - n) // BLOCK * BLOCK
    return _headers_in(source.read(base, source.size - base), base)


def boundary(source: Source, is_left: Callable[[list[tuple[str, int, str, int]]], bool], probe: int = 4 << 20, steps: int = 20) -> tuple[int, int]:
    """(low, high) around the place up to which probes' members are left of what is looked for, by bisection."""
    low, high = 0, source.size
    while steps and high - low >= probe:
        middle = (low + high) // 2 // BLOCK * BLOCK
        if is_left(_headers_in(source.read(middle, probe), middle)):
            low = middle
        else:
            high = middle
        steps -= 1
    return low, high


def sections(source: Source, before: Callable[[str], bool], endings: dict[str, str], probe: int = 4 << 20) -> dict[str, tuple[str, int, str, int]]:
    """Members by the ending of their names, looked for from the end of the section whose names ``before`` accepts."""
    low, _ = boundary(source, lambda found: any(before(m[0]) for m in found), probe)
    out: dict[str, tuple[str, int, str, int]] = {}
    start = next((m for m in _headers_in(source.read(low, probe), low)), None)
    for m in members(source, start[3] - BLOCK if start else low):
        for key, ending in endings.items():
            if key not in out and m[0].endswith(ending):
                out[key] = m
        if len(out) == len(endings):
            break
    return out


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, length) of the files that fit the path; their content isn't read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "length")


def scan(listed: DataFrame, prefix: str = "", suffix: str = "", index_only: bool = False, names: set[str] | None = None, mount: str | None = None, base_url: str | None = None, token: str | None = None) -> DataFrame:
    """One row per member of the listed archives (archive: path or address) whose name fits; ``index_only`` leaves the data out, unread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                source = open_source(archive, mount, base_url, token)
                try:
                    for name, size, kind, offset in members(source):
                        if not (name.startswith(prefix) and name.endswith(suffix) and (names is None or name in names)):
                            continue
                        data = None if index_only else source.read(offset, size)
                        rows.append((archive, name, size, kind, offset, data))
                        held += len(data or b"") + 100
                        if held > BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                finally:
                    source.close()
        if rows:
            yield _batch(rows)

    from strandline.session import ship

    ship(listed.sparkSession)
    return listed.select("archive").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], ["archive", "name", "size", "kind", "offset", "data"])


def read_members(index: DataFrame, **where: str | None) -> DataFrame:
    """The data of indexed members (archive, name, size, kind, offset), each by one read at its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, opened = None, None
            for r in batch.select(["archive", "name", "size", "kind", "offset"]).to_pylist():
                if r["archive"] != opened:
                    if source:
                        source.close()
                    source, opened = open_source(r["archive"], **where), r["archive"]
                yield _batch([(r["archive"], r["name"], r["size"], r["kind"], r["offset"], source.read(r["offset"], r["size"]))])
            if source:
                source.close()

    from strandline.session import ship

    ship(index.sparkSession)
    return index.select("archive", "name", "size", "kind", "offset").mapInArrow(run, SCHEMA)


def read_tar(spark: SparkSession, path: str, prefix: str = "", suffix: str = "", index_only: bool = False) -> DataFrame:
    """One row per member whose name fits of the archives that fit the path."""
    return scan(archives(spark, path), prefix, suffix, index_only)


def clip_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, meta, frames) of clip archives: the JSON of meta.json, and the frames (name, data) in order of their names."""
    found = scan(archives(spark, path))
    base = F.regexp_extract("name", "([^/]*)$", 1)
    frame = F.startswith("name", F.lit("frames/")) & F.endswith("name", F.lit(".jpg"))
    rows = found.groupBy("archive").agg(
        F.max(F.when(F.col("name") == "meta.json", F.decode("data", "UTF-8"))).alias("meta"), F.sort_array(F.collect_list(F.when(frame, F.struct(base.alias("name"), "data")))).alias("frames")
    )
    return rows.withColumn("meta", F.when(F.try_parse_json("meta").isNull(), F.raise_error(F.lit("meta.json is missing or no JSON")).cast("string")).otherwise(F.col("meta")))


def transcript_of(source: Source, ending: str = "audio/transcript.txt", before: Callable[[str], bool] = lambda n: "eye_tracking/" in n and n.endswith(".jpg")) -> str:
    """The transcript of an archive whose sections stand in the usual order; an empty text if there is none."""
    found = sections(source, before, {"transcript": ending}).get("transcript")
    return source.read(found[3], found[1]).decode("utf-8", "replace") if found else ""


