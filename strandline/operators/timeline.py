"""Timelines: context and future windows, fills across sessions, islands, quotas and samples."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Place of each row in its timeline, from 0, and the timeline's length."""
    by = Window.partitionBy(*key)
    return df.withColumn(name, F.row_number().over(by.orderBy(*order)) - 1).withColumn(f"{name}_count", F.count(F.lit(1)).over(by))


def with_context(df: DataFrame, key: Sequence[str], order: Sequence[str], item: str, before: int, name: str = "context") -> DataFrame:
    """The preceding items in order."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-before, -1)
    return df.withColumn(name, F.collect_list(item).over(w))


def with_future(df: DataFrame, key: Sequence[str], order: Sequence[str], item: str, k: int, name: str = "ground_truth") -> DataFrame:
    """The row's own item and those behind it, ``k`` in all."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(0, k - 1)
    return df.withColumn(name, F.collect_list(item).over(w))


def last_items(items: Column, k: int) -> Column:
    """The last k of an array, all of a shorter one."""
    n = F.least(F.lit(k), F.size(items))
    return F.when(n > 0, F.slice(items, F.greatest(F.size(items) - k + 1, F.lit(1)), F.greatest(n, F.lit(1)))).otherwise(F.slice(items, 1, 0))


def eligible(df: DataFrame, before: int, after: int, least: int | None = None, pos: str = "pos") -> DataFrame:
    """Cutoffs in [before, count - after), in timelines of over ``least`` rows."""
    rows = df.filter((F.col(pos) >= before) & (F.col(pos) < F.col(f"{pos}_count") - after))
    return rows.filter(F.col(f"{pos}_count") > least) if least is not None else rows


def backward_fill(points: DataFrame, events: DataFrame, key: Sequence[str], before: int, item: str, point_pos: str = "end_pos", pos: str = "pos", name: str = "context") -> DataFrame:
    """The last ``before`` items of a point's timeline up to its position, in order, across sessions; none as an empty array."""
    w = Window.partitionBy(*key).orderBy(pos).rowsBetween(-(before - 1), 0)
    return _at(points, events.select(*key, F.col(pos).alias("_pos"), F.collect_list(item).over(w).alias(name)), key, F.col(point_pos), name)


def forward_fill(points: DataFrame, events: DataFrame, key: Sequence[str], k: int, item: str, point_pos: str = "start_pos", pos: str = "pos", name: str = "ground_truth") -> DataFrame:
    """The next ``k`` items strictly behind a point's position (-1 for the beginning); none as an empty array."""
    w = Window.partitionBy(*key).orderBy(pos).rowsBetween(0, k - 1)
    return _at(points, events.select(*key, F.col(pos).alias("_pos"), F.collect_list(item).over(w).alias(name)), key, F.col(point_pos) + 1, name)


def _at(points: DataFrame, filled: DataFrame, key: Sequence[str], at: Column, name: str) -> DataFrame:
    """Points with what the windows hold at a position; windows are made once per event, so no point meets a whole timeline."""
    joined = points.withColumn("_pos", at.cast("long")).join(filled.withColumn("_pos", F.col("_pos").cast("long")), [*key, "_pos"], "left")
    return joined.select(*points.columns, F.coalesce(name, F.array().cast(joined.schema[name].dataType)).alias(name))


def recording_bounds(events: DataFrame, recordings: DataFrame, key: Sequence[str], rec: str = "recording", order: str = "rec_no", pos: str = "pos") -> DataFrame:
    """For each recording in order, and each timeline, the positions of its first and last event: an empty one lies between its neighbours.

    ``recordings`` has (rec, order) and, in front of them, the timeline's ``key``.
    """
    n = events.groupBy(*key, rec).agg(F.count(F.lit(1)).alias("_n"))
    rows = recordings.join(n, [*key, rec], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    upto = F.sum("_n").over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("first_pos", upto - F.col("_n")).withColumn("last_pos", upto - 1).drop("_n")


def recording_context(points: DataFrame, events: DataFrame, bounds: DataFrame, key: Sequence[str], most: int, item: str, rec: str = "recording") -> DataFrame:
    """The ``most`` items that precede a point's ground truth, across recordings.

    They end with the point's context recording (``context_recording``). Where the timeline begins too
    late, items behind that recording fill up, but none at or past the first recording of the
    ground truth (``gt_first``); without one nothing is filled up.
    """
    ends = bounds.select(*key, F.col(rec).alias("context_recording"), F.col("last_pos").alias("_end"))
    starts = bounds.select(*key, F.col(rec).alias("gt_first"), F.col("first_pos").alias("_gt"))
    rows = points.join(ends, [*key, "context_recording"]).join(starts, [*key, "gt_first"], "left")
    rows = backward_fill(rows, events, key, most, item, "_end", name="_before")
    rows = forward_fill(rows, events, key, most, item, "_end", name="_behind")
    room = F.least(most - F.size("_before"), F.greatest(F.coalesce(F.col("_gt") - F.col("_end") - 1, F.lit(0)), F.lit(0))).cast("int")
    return rows.select(*points.columns, F.concat("_before", F.slice("_behind", F.lit(1), room)).alias("context"))


def extended_truth(points: DataFrame, events: DataFrame, bounds: DataFrame, key: Sequence[str], most: int, item: str, truth: str = "ground_truth", rec: str = "recording") -> DataFrame:
    """Ground truths filled up to ``most`` with items of the recordings behind their last one (``gt_last``)."""
    ends = bounds.select(*key, F.col(rec).alias("gt_last"), F.col("last_pos").alias("_end"))
    rows = forward_fill(points.join(ends, [*key, "gt_last"], "left"), events, key, most, item, "_end", name="_behind")
    room = F.greatest(most - F.size(truth), F.lit(0))
    return rows.select(*[c for c in points.columns if c != truth], F.concat(truth, F.slice("_behind", F.lit(1), room)).alias(truth))


def truth_from_cutoff(points: DataFrame, events: DataFrame, key: Sequence[str], most: int, item: str, day: str = "day", line: str = "line_no") -> DataFrame:
    """The ``most`` items from a point's day and cutoff line on, through the next days, and their spans (day, first_line, n).

    ``events`` has positions over all days of a timeline; a cutoff behind a day's last line counts as the next day's first.
    """
    days = events.groupBy(*key, day).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    rows = points.join(days, [*key, day]).withColumn("_start", F.col("_first") + F.least("cutoff_line", "_n") - 1)
    tagged = events.withColumn("_item", F.struct(F.col(day).alias("day"), F.col(line).alias("line"), F.col(item).alias("item")))
    rows = forward_fill(rows, tagged, key, most, "_item", "_start", name="_found")
    spans = F.transform(
        F.array_distinct(F.transform("_found", lambda x: x["day"])),
        lambda d: F.struct(d.alias("day"), F.array_min(F.transform(F.filter("_found", lambda x: x["day"] == d), lambda x: x["line"])).alias("first_line"), F.size(F.filter("_found", lambda x: x["day"] == d)).alias("n")),
    )
    return rows.select(*points.columns, F.transform("_found", lambda x: x["item"]).alias("ground_truth"), spans.alias("spans"))


def segments_of(items: Column) -> Column:
    """(recording, start, end, n) of each run of (recording, start, end): the first start and the last end that are known."""
    def run(r: Column) -> Column:
        mine = F.filter(items, lambda x: x["recording"] == r)
        known = lambda part: F.filter(F.transform(mine, lambda x: x[part]), lambda v: v.isNotNull())
        return F.struct(r.alias("recording"), F.get(known("start"), F.lit(0)).alias("start"), F.try_element_at(known("end"), F.lit(-1)).alias("end"), F.size(mine).alias("n"))

    return F.transform(F.array_distinct(F.transform(items, lambda x: x["recording"])), run)


def time_bounds(lines: DataFrame, by: Sequence[str], order: str, start: str, end: str, unknown: str = "??:??:??") -> DataFrame:
    """First known start and last known end of each group's lines."""
    first = F.min_by(start, F.when(F.col(start).isNotNull(), F.col(order)))
    last = F.max_by(end, F.when(F.col(end).isNotNull(), F.col(order)))
    return lines.groupBy(*by).agg(F.coalesce(first, F.lit(unknown)).alias("start"), F.coalesce(last, F.lit(unknown)).alias("end"))


def complete(points: DataFrame, *arrays: str, least: int = 1) -> DataFrame:
    """Points whose arrays all hold at least ``least`` items."""
    rows = points
    for a in arrays:
        rows = rows.filter(F.coalesce(F.size(a), F.lit(0)) >= least)
    return rows


def numbered_ids(df: DataFrame, order: Sequence[str], name: str = "id", form: str = "eval_%04d") -> DataFrame:
    """Ids by place, from 0, in one order over all rows: for evaluation points, not for events."""
    return df.withColumn(name, F.format_string(form, F.row_number().over(Window.orderBy(*order)) - 1))


def islands(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, start: str, end: str) -> DataFrame:
    """Runs of equal values: number, value, first start, last end and length."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("changed", change).withColumn("run", F.sum("changed").over(w))
    place = F.struct(*order)
    return runs.groupBy(*key, "run", value).agg(F.min_by(start, place).alias("start"), F.max_by(end, place).alias("end"), F.count(F.lit(1)).alias("n"))


def allocate(groups: DataFrame, total: int, order: Sequence[str], count: str = "n") -> DataFrame:
    """Shares of ``total`` in proportion to counts, at least 1 each while there is any; the last group takes the rest.

    One row per group comes in; half shares round to even.
    """
    every, upto = Window.partitionBy(), Window.orderBy(*order)
    share = F.greatest(F.lit(1), F.bround(F.lit(total) * F.col(count) / F.sum(count).over(every), 0).cast("long"))
    rows = groups.withColumn("share", share).withColumn("before", F.coalesce(F.sum("share").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.greatest(F.lit(0), F.lit(total) - F.col("before"))
    last = F.row_number().over(upto) == F.count(F.lit(1)).over(every)
    return rows.withColumn("quota", F.when(last, left).otherwise(F.least(F.col("share"), left)).cast("long")).drop("share", "before")


def even_split(groups: DataFrame, total: int, order: Sequence[str]) -> DataFrame:
    """Equal shares, one more for the first ``total`` mod n."""
    place, n = F.row_number().over(Window.orderBy(*order)), F.count(F.lit(1)).over(Window.partitionBy())
    return groups.withColumn("quota", (F.floor(F.lit(total) / n) + F.when(place <= F.lit(total) % n, 1).otherwise(0)).cast("long"))


def hashed_sample(df: DataFrame, strata: Sequence[str], key: str, n: int | Column, seed: str = "42") -> DataFrame:
    """``n`` rows per stratum (a number, or a column with the stratum's quota) in the order of a seeded hash of the key: the same on every run and layout."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def seeded_positions(counts: dict[str, tuple[int, int, int]], seed: int = 42) -> list[tuple[str, int]]:
    """(group, position) of samples without replacement, drawn group after group from one seeded generator and sorted within each.

    ``counts`` has (first position, end, wanted) per group: a small table of quotas, not rows.
    """
    rng, out = random.Random(seed), []
    for group, (low, high, wanted) in counts.items():
        if high > low:
            out += [(group, p) for p in sorted(rng.sample(range(low, high), min(wanted, high - low)))]
    return out


def shuffled_take(sizes: dict[str, int], total: int, seed: int = 42) -> list[tuple[str, int]]:
    """(group, place): the first of each group's shuffled places, as many as an even split of ``total`` gives it, groups by name and one generator for all."""
    rng, out = random.Random(seed), []
    for i, (group, n) in enumerate(sorted(sizes.items())):
        places = list(range(n))
        rng.shuffle(places)
        out += [(group, p) for p in places[: total // len(sizes) + (i < total % len(sizes))]]
    return out[:total]


def first_of_quota(df: DataFrame, strata: Sequence[str], order: Sequence[str], quota: str) -> DataFrame:
    """The first rows of each stratum, as many as its quota."""
    w = Window.partitionBy(*strata).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= F.col(quota)).drop("_rank")


def even_step(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Every step-th row, step = max(1, count // n), the first n of these."""
    by = Window.partitionBy(*key)
    rows = df.withColumn("i", F.row_number().over(by.orderBy(*order)) - 1).withColumn("c", F.count(F.lit(1)).over(by))
    step = F.greatest(F.lit(1), F.floor(F.col("c") / n))
    return rows.filter((F.col("i") % step == 0) & (F.col("i") / step < n)).drop("i", "c")


def hold_until_next(df: DataFrame, key: Sequence[str], order: Sequence[str], at: str, last: Column) -> DataFrame:
    """A reading holds until the next one; the last until ``last``."""
    return df.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(*key).orderBy(*order)), last))


def trail(df: DataFrame, key: Sequence[str], order: Sequence[str], valid: Column, item: str, n: int = 6) -> DataFrame:
    """The last n valid items on each valid row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.filter(valid).withColumn("trail", F.collect_list(item).over(w))
