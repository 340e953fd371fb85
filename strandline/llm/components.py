"""Connected components of an edge table by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.cluster import settled

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (large) or smaller-or-equal (small) neighbours are linked to the least one around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    near = both.join(least, "a")
    if large:
        out = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, label): each node on an edge, and the least node reachable from it.

    Rounds write their edges to the shared folder, so no lineage grows and no driver holds links.
    """
    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        edges = settled(_star(_star(edges, True), False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == mark:
            labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
        mark = tuple(now)
    raise RuntimeError("the components did not settle")
