"""Helpers that keep the operators independent of the machine they run on."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import ship

#: A key is hot if it holds more than this fraction's share of the rows.
HOT_KEYS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is set only where none is named (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder and read from there; its lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that nothing refers to any more (its cleaner acts on garbage collection)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: compressed, and readers prune its columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strandline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], n: str) -> DataFrame:
    """Rows of ``big`` with their row of ``small``: a written table of one row per key with the number ``n`` of that key's rows in ``big``.

    Keys that hold over 1 / HOT_KEYS of all these rows, of which there are fewer than HOT_KEYS, are
    broadcast, so no key has its rows dealt to one task. The others meet in a shuffle.
    """
    total, most = small.agg(F.sum(n), F.max(n)).first()
    if total is None or most * HOT_KEYS <= total:
        return big.join(small.drop(n), on)
    hot = F.broadcast(small.filter(F.col(n) * HOT_KEYS > total).drop(n))
    rest = big.join(hot.select(*on), on, "left_anti").join(small.filter(F.col(n) * HOT_KEYS <= total).drop(n), on)
    return big.join(hot, on).unionByName(rest)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named input columns under internal names, so that other columns can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])
