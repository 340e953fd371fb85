"""Sessions, and how the package reaches the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def session(name: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; keyword names use __ for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers once per application, so that it needn't be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="strandline-code-")
    sc.addPyFile(shutil.make_archive(f"{folder}/strandline", "zip", _ROOT.parent, _ROOT.name))
    sc._strandline_shipped = True
