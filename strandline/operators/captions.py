"""Clips and segments: filters, merges, roll-ups, cost, and the delivery index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import recording_day, seconds_of, strip, time_range
from strandline.operators import joins

# Dollars per million tokens.
INPUT_PRICE, OUTPUT_PRICE = 0.75, 3.75


def ok_truthy(ok: Column) -> Column:
    return F.coalesce(ok.cast("boolean"), F.lit(False))


def not_failed(ok: Column) -> Column:
    """Only an explicit false drops."""
    return ~ok.eqNullSafe(F.lit(False))


def truthy(*choices: Column) -> Column:
    """The first non-empty array or map; an empty one falls through."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in choices])


def segments(clips: DataFrame, keep: Sequence[str], array: str) -> DataFrame:
    """One row per segment (time_range, action, ...) that has a start, an end and an action; start and end come from the range."""
    rows = clips.select(*keep, F.posexplode(array).alias("segment_no", "segment")).select(*keep, "segment_no", "segment.*")
    span = time_range(F.col("time_range"))
    rows = rows.withColumn("start", span["start"]).withColumn("end", span["end"]).withColumn("action", strip(F.col("action")))
    return rows.filter((F.col("start") != "") & (F.col("end") != "") & (F.col("action") != ""))


def event_lines(found: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Event lines of segments, numbered in the order of their start strings; ties keep the given order."""
    w = Window.partitionBy(*by).orderBy("start", *order)
    line = F.concat(F.lit("["), "start", F.lit(" -> "), "end", F.lit("] "), "action")
    return found.select(*by, (F.row_number().over(w) - 1).alias("line_no"), line.alias("line"))


def cost(tokens_in: Column, tokens_out: Column, thinking: Column, digits: int = 4) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.round(zero(tokens_in) / 1e6 * INPUT_PRICE + (zero(tokens_out) + zero(thinking)) / 1e6 * OUTPUT_PRICE, digits)


def recording_rollup(clips: DataFrame, by: Sequence[str], order: str, ok: str, start: str, end: str, sums: Sequence[str]) -> DataFrame:
    """Counts, failed clips, sums, and first and last times by the clips' order."""
    good = ok_truthy(F.col(ok))
    return clips.groupBy(*by).agg(
        F.count_if(good).alias("n_ok"),
        F.count_if(~good).alias("n_failed"),
        F.sort_array(F.collect_list(F.when(~good, F.col(order)))).alias("failed"),
        *[F.sum(c).alias(c) for c in sums],
        F.min_by(start, order).alias("first"),
        F.max_by(end, order).alias("last"),
    )


def delivery_index(clips: DataFrame, by: Sequence[str], kept: Column, minutes: Column, first_part: Column) -> DataFrame:
    """Usable and selected clips with their share, minutes, and the sums within the first part."""
    return clips.groupBy(*by).agg(
        F.count_if(kept).alias("usable_clips"),
        F.count(F.lit(1)).alias("target_clips"),
        F.round(F.try_divide(F.count_if(kept), F.count(F.lit(1))), 3).alias("coverage"),
        F.sum(F.when(kept, minutes).otherwise(F.lit(0))).alias("minutes"),
        F.count_if(kept & first_part).alias("in_first"),
    )


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Map from value to count per group; the values' counts are aggregated before they are gathered."""
    n = df.groupBy(*by, value).count()
    return n.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value), F.col("count"))))).alias("counts"))


def ordered_text(df: DataFrame, by: Sequence[str], order: Sequence[str], line: Column, separator: str = "\n") -> DataFrame:
    """Lines of each group joined in order."""
    found = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(found, lambda x: x["line"]), separator).alias("text"))


def tumbling(index: Column, size: int) -> Column:
    return F.floor(index / size)


def without_private(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: ~k.startswith("_"))


def dense_frames(df: DataFrame, by: Sequence[str], order: str, text: str, least: int = 40, fallback: int = 4) -> DataFrame:
    """Frames with enough text; the first ones of a group without any text at all."""
    solid = F.char_length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s", ""))
    w = Window.partitionBy(*by)
    rows = df.withColumn("_solid", solid).withColumn("_any", F.max(F.col(text) != "").over(w)).withColumn("_place", F.row_number().over(w.orderBy(order)))
    return rows.filter((F.col("_solid") >= least) | (~F.coalesce("_any", F.lit(False)) & (F.col("_place") <= fallback))).drop("_solid", "_any", "_place")


def strided(df: DataFrame, by: Sequence[str], order: str, step: int) -> DataFrame:
    """Every step-th row from the first one."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_place", place).filter((F.col("_place") - 1) % step == 0).drop("_place")


def strictly_ok(clips: DataFrame, clip: str) -> DataFrame:
    """Adds state to variants: kept for objects whose ok is the boolean true, failed for all others."""
    v = F.col(clip)
    ok = F.try_variant_get(v, "$.ok", "variant")
    fine = (F.schema_of_variant(v).startswith("OBJECT")) & (F.schema_of_variant(ok) == "BOOLEAN") & F.try_variant_get(v, "$.ok", "boolean")
    return clips.withColumn("state", F.when(F.coalesce(fine, F.lit(False)), "kept").otherwise("failed"))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def model_comparison(clips: DataFrame, prices: DataFrame) -> DataFrame:
    """Per model over its ok clips: means of what their segments hold, tokens, latency and cost a clip.

    ``clips`` has (model, ok, segments, tokens_in, tokens_out, seconds); ``prices`` (model, price_in, price_out) in dollars
    per million tokens. Models without an ok clip are left out.
    """
    length = lambda x: F.char_length(F.coalesce(x.cast("string"), F.lit("")))
    items = lambda x: F.coalesce(F.size(x), F.lit(0))
    total = lambda of: F.aggregate(F.coalesce("segments", F.array().cast(clips.schema["segments"].dataType)), F.lit(0).cast("long"), lambda a, s: a + of(s))
    figures = {
        "n_segments": total(lambda s: F.lit(1)),
        "speech": total(lambda s: F.when(F.coalesce(s["speech"], F.lit("")) != "", 1).otherwise(0)),
        "text_items": total(lambda s: items(s["text_visible"])),
        "objects": total(lambda s: items(s["objects"])),
        "chars": total(lambda s: length(s["action"]) + length(s["details"]) + length(s["environment"])),
    }
    rows = clips.filter(ok_truthy(F.col("ok"))).select("model", *[c.alias(k) for k, c in figures.items()], F.coalesce("tokens_in", F.lit(0)).alias("tin"), F.coalesce("tokens_out", F.lit(0)).alias("tout"), "seconds")
    n = F.count(F.lit(1))
    per = rows.groupBy("model").agg(n.alias("clips"), *[F.round(F.sum(k) / n, 1).alias(k) for k in figures], F.sum("tin").alias("tin"), F.sum("tout").alias("tout"), F.round(F.sum("seconds") / n, 1).alias("seconds"))
    priced = per.join(prices, "model", "left")
    price = lambda c, usual: F.coalesce(c, F.lit(usual))
    each = F.col("tin") / F.col("clips") / 1e6 * price("price_in", INPUT_PRICE) + F.col("tout") / F.col("clips") / 1e6 * price("price_out", OUTPUT_PRICE)
    return priced.select("model", "clips", *figures, F.expr("tin div clips").alias("tokens_in"), F.expr("tout div clips").alias("tokens_out"), "seconds", F.round(each, 4).alias("cost_per_clip"))


def cost_by_wave(totals: DataFrame, moved: Sequence[str], first_of_second: str, year: int, prefix: int = 28) -> DataFrame:
    """Cost, clips and ok clips of both waves: recordings named in ``moved`` (whole, or either cut at ``prefix``) are of wave B, others by day."""
    wave = joins.in_either_prefix(F.col("recording"), moved, prefix)
    day = recording_day(F.col("recording"), year)
    rows = totals.withColumn("wave", F.when(wave, "B").when(day < first_of_second, "A").otherwise("B"))
    return rows.groupBy("wave").agg(F.sum("usd").alias("usd"), F.sum("clips").alias("clips"), F.sum("ok").alias("ok"))


def models_by_scene(results: DataFrame, order: str) -> DataFrame:
    """The models of each scene's results without an error, in the order of arrival."""
    fine = results.filter(F.coalesce(F.col("error"), F.lit("")) == "")
    return fine.groupBy("scene").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "model"))), lambda x: x["model"]).alias("models"))


def readings(crops: DataFrame, by: Sequence[str], order: str, clip_end: str) -> DataFrame:
    """Crop readings (hkt, label, summary, text) grouped by time, each holding until the next one, the last to the clip's end or for a second.

    Gives start, end, action (the distinct labels), objects and text_visible; times of another form are left out.
    """
    fine = crops.withColumn("hkt", strip(F.col("hkt"))).filter(F.col("hkt").rlike(r"^\d{1,2}:\d{2}:\d{2}$")).withColumn("label", F.coalesce("label", F.lit("screen")))
    said = F.when(F.coalesce(F.col("summary"), F.lit("")) != "", F.array(F.concat(F.lit("["), "label", F.lit("] "), "summary"))).otherwise(F.array().cast("array<string>"))
    row = F.struct(order, "label", F.concat(said, F.coalesce("text", F.array().cast("array<string>"))).alias("lines"))
    groups = fine.groupBy(*by, "hkt", clip_end).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    following = F.lead("hkt").over(Window.partitionBy(*by).orderBy("hkt"))
    until = F.coalesce(following, F.nullif(F.substring(F.col(clip_end), -8, 8), F.lit("")), F.col("hkt"))
    a_second = seconds_of(F.col("hkt")) + 1
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    later = F.concat_ws(":", two(F.floor(a_second / 3600) % 24), two(F.floor(a_second / 60) % 60), two(a_second % 60))
    labels = F.array_distinct(F.transform("rows", lambda r: r["label"]))
    return groups.withColumn("until", until).select(
        *by, F.col("hkt").alias("start"), F.when(F.col("until") <= F.col("hkt"), later).otherwise(F.col("until")).alias("end"), F.array_join(labels, " / ").alias("action"), labels.alias("objects"),
        F.flatten(F.transform("rows", lambda r: r["lines"])).alias("text_visible"),
    )


def coverage(done: DataFrame, total: DataFrame, on: str) -> DataFrame:
    """One row: ok/total as text, and both numbers."""
    ok, n = done.select(on).distinct().agg(F.count(F.lit(1)).alias("ok")), total.agg(F.count(F.lit(1)).alias("total"))
    one = ok.withColumn("_", F.lit(1)).join(n.withColumn("_", F.lit(1)), "_")
    return one.select(F.concat_ws("/", F.col("ok").cast("string"), F.col("total").cast("string")).alias("coverage"), "ok", "total")


def best_match(wanted: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """For each (scene, hint) the first result (scene, model, content) of its scene and model, else of its scene, else the first of all.

    Scenes match if one name holds the other; a missing hint fits every model. A match without content takes the first of all too.

    Names meet by equi-joins on their substrings, of those lengths alone that the other side's names have: rows grow with the
    number of names (and with the square of a name's length at most), not with the product of both sides. Results are
    reduced by scene and model before, and by substring and model before they meet ``wanted``; contents are looked up last.
    """
    asked = wanted.select("scene", "hint").distinct()
    known = results.filter("scene is not null").groupBy(F.col("scene").alias("of"), "model").agg(F.min(order).alias("at"))
    held = joins.substrings_of(known, asked, "of", "scene").groupBy(F.col("part").alias("scene"), "model").agg(F.min(F.struct("at", "of")).alias("first"))
    holders = asked.join(held.select("scene", "model", "first.*"), "scene")
    holding = joins.substrings_of(asked, known, "scene", "of").join(known.withColumnRenamed("of", "part"), "part").withColumnRenamed("part", "of")
    model = (F.coalesce(F.col("hint"), F.lit("")) == "") | F.contains(F.lower("model"), F.lower("hint"))
    pick = F.struct(F.when(model, 0).otherwise(1).alias("miss"), "at", "of", "model").alias("pick")
    pairs = holders.select("scene", "hint", pick).unionByName(holding.select("scene", "hint", pick)).unionByName(asked, allowMissingColumns=True)
    found = pairs.groupBy("scene", "hint").agg(F.min("pick").alias("pick"))
    texts = results.groupBy(F.col("scene").alias("of"), "model").agg(F.min(F.struct(F.col(order).alias("at"), "content"))["content"].alias("content"))
    same = (F.col("pick.of") == F.col("t.of")) & F.col("pick.model").eqNullSafe(F.col("t.model"))
    first = results.agg(F.min(F.struct(F.col(order).alias("at"), "content"))["content"].alias("any"))
    met = found.join(texts.alias("t"), same, "left").select("scene", "hint", "content")
    return met.crossJoin(F.broadcast(first)).select("scene", "hint", F.coalesce("content", "any").alias("content"))


def shown_scenes(results: DataFrame, order: str, only: DataFrame | None = None) -> DataFrame:
    """Scenes whose first pass is ok and that have a merged caption (pass1_ok, merged), in order; with ``only`` (scene) those of it."""
    fine = results.filter(ok_truthy(F.col("pass1_ok")) & (F.coalesce(F.col("merged"), F.lit("")) != "")).select("scene", order)
    return (fine if only is None else fine.join(only.select("scene"), "scene", "left_semi")).orderBy(order)


def latest_file(files: DataFrame, name: str, prefixes: Sequence[str]) -> DataFrame:
    """The last name of the first prefix that any file has."""
    rank = F.coalesce(*[F.when(F.startswith(F.col(name), F.lit(p)), k) for k, p in enumerate(prefixes)])
    return files.withColumn("_rank", rank).filter("_rank is not null").orderBy("_rank", F.desc(name)).limit(1).drop("_rank")
