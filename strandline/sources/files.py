"""Readers and writers for JSON lines, event text, reply streams, vector caches and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Strict: a line that isn't JSON fails the job, blank lines don't count."""
    lines = spark.read.text(path).filter(F.btrim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json_lenient(spark: SparkSession, path: str, order: str = "$.clip_id") -> DataFrame:
    """Whole files as variants, bad ones left out, by clip id (0 if absent)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("clip"))
    return files.filter(F.col("clip").isNotNull()).withColumn("clip_id", F.coalesce(F.try_variant_get("clip", order, "long"), F.lit(0)))


def _no_nan(c: Column, kind: T.DataType, at: str) -> Column | None:
    """The column with a check of every number below it, or None if it holds none."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(odd, F.raise_error(F.lit(f"NaN or infinity in {at}")).cast(kind)).otherwise(c)
    if isinstance(kind, T.ArrayType):
        if _no_nan(F.lit(None).cast(kind.elementType), kind.elementType, at) is not None:
            return F.transform(c, lambda x: _no_nan(x, kind.elementType, at))
    if isinstance(kind, T.MapType):
        if _no_nan(F.lit(None).cast(kind.valueType), kind.valueType, at) is not None:
            return F.transform_values(c, lambda _, x: _no_nan(x, kind.valueType, at))
    if isinstance(kind, T.StructType):
        parts = [(f.name, _no_nan(c[f.name], f.dataType, f"{at}.{f.name}")) for f in kind.fields]
        if any(x is not None for _, x in parts):
            return F.when(c.isNotNull(), F.struct(*[(c[n] if x is None else x).alias(n) for n, x in parts]))
    return None


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; a NaN or infinity anywhere, in lists, maps and structs too, fails the job, and so does a path that exists."""
    checked = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        found = _no_nan(c, f.dataType, f.name)
        checked.append((c if found is None else found).alias(f.name))
    df.select(*checked).write.mode("errorifexists").json(path)


def page(df: DataFrame, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Offset, then limit; no limit, or 0, means all."""
    rows = df.orderBy(order).offset(offset)
    return rows.limit(limit) if limit else rows


def numbered_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """Lines of whole files with their numbers; without blanks the numbers count the other lines only."""
    breaks = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
    split = F.split(F.regexp_replace("value", f"(?:{breaks})$", ""), breaks)
    lines = split if keep_blank else F.filter(split, lambda x: F.regexp_replace(x, r"(?U)\s", "") != "")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(lines).alias("line_no", "line"))


def path_part(path: Column, from_end: int) -> Column:
    """A component of a path, counted from its end."""
    return F.element_at(F.split(path, "/"), -from_end)


def inventory(lines: DataFrame) -> DataFrame:
    """Events per source, participant, level and day from .../<source>/<participant>/<level>/<day>.txt; hidden names left out."""
    part = lambda k: path_part(F.col("path"), k)
    rows = lines.select(part(4).alias("source"), part(3).alias("participant"), part(2).alias("level"), F.regexp_replace(part(1), r"\.txt$", "").alias("day"))
    return rows.filter(~F.startswith("participant", F.lit("."))).groupBy("source", "participant", "level", "day").agg(F.count(F.lit(1)).alias("events"))


def reply_chunks(spark: SparkSession, path: str) -> DataFrame:
    """`data:` lines of reply streams in order: text, whether it is thought, cumulative token counts."""
    return chunks_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value"))


def chunks_of(files: DataFrame) -> DataFrame:
    """The chunks of whole reply files (path, value), of a table or of a stream."""
    raw = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("chunk_no", "line"))
    body = raw.filter(F.startswith("line", F.lit("data:"))).withColumn("v", F.try_parse_json(F.regexp_replace("line", r"^data:\s*", ""))).filter(F.col("v").isNotNull())
    parts = F.try_variant_get("v", "$.candidates[0].content.parts", "array<struct<text:string,thought:boolean>>")
    text = F.array_join(F.transform(F.filter(parts, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    count = lambda name: F.try_variant_get("v", f"$.usageMetadata.{name}", "long")
    return body.select("path", "chunk_no", F.coalesce(text, F.lit("")).alias("text"), count("promptTokenCount").alias("tokens_in"), count("candidatesTokenCount").alias("tokens_out"), count("thoughtsTokenCount").alias("tokens_thought"))


def replies(chunks: DataFrame) -> DataFrame:
    """Each stream's text in order without fences, and its last counts."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "text"))), lambda c: c["text"]), "")
    bare = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_no"))).alias(c)
    return chunks.groupBy("path").agg(bare.alias("payload"), F.count(F.lit(1)).alias("chunks"), last("tokens_in"), last("tokens_out"), last("tokens_thought"))


def cache_key(text: Column, model: str = "", dim: int = 0) -> Column:
    """The key of a text's vector: SHA-1, with model and width in front where they are given."""
    return F.concat_ws("|", F.lit(model), F.lit(str(dim)), F.sha1(text)) if model else F.sha1(text)


def cached(requests: DataFrame, cache: DataFrame, text: str = "text", model: str = "", dim: int = 0) -> tuple[DataFrame, DataFrame]:
    """Distinct texts that the vector cache has, and those that are to be fetched."""
    keyed = requests.select(text).distinct().withColumn("key", cache_key(F.col(text), model, dim))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def cache_put(cache: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """The cache (key, vector) with the fresh rows in the place of those of the same key, written as a new table."""
    cache.join(fresh, "key", "left_anti").unionByName(fresh.dropDuplicates(["key"])).write.mode("errorifexists").parquet(path)
    return cache.sparkSession.read.parquet(path)


def batch_requests(df: DataFrame, key: str, prompt: str) -> DataFrame:
    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("key"), F.struct(F.col(prompt).alias("prompt")).alias("request"))).alias("value"))
