"""Incremental totals over arriving clip files, and the budget gate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def arriving(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def totals(clips: DataFrame, once_by: Sequence[str], by: Sequence[str], cost: Column, ok: Column, at: str | None = None, late: str = "1 day") -> DataFrame:
    """Each clip counts once, whatever files repeat it; works on streams and tables alike.

    On a stream the clips seen are kept for ever, unless ``at`` names a time column: then a repeat is
    looked for within ``late`` of the newest time, and older clips leave the state.
    """
    once = clips.dropDuplicates(list(once_by)) if at is None else clips.withWatermark(at, late).dropDuplicatesWithinWatermark(list(once_by))
    return once.groupBy(*by).agg(F.count(F.lit(1)).alias("clips"), F.count_if(ok).alias("ok"), F.sum(cost).alias("cost"))


def gate(spent: DataFrame, cap: float, cost: str = "cost") -> DataFrame:
    """One row with the total and whether it has reached the cap."""
    return spent.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("total")).withColumn("stop", F.col("total") >= cap)


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(df: DataFrame, cap: float, act: Callable[[float], None], checkpoint: str, cost: str = "cost") -> StreamingQuery:
    """Calls ``act`` with the total of each batch that reaches the cap; the state of progress is the checkpoint."""

    def each(batch: DataFrame, _: int) -> None:
        row = gate(batch, cap, cost).first()
        if row["stop"]:
            act(row["total"])

    return df.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_replies(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Reply streams as they arrive, a whole file at a time: path and value."""
    lines = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", per_trigger).text(path)
    return lines.select(F.input_file_name().alias("path"), "value")
