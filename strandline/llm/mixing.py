"""Mixing sources to target weights by pivotal dependent rounding, in Spark SQL expressions only.

A source's target divided by its size is the wanted number of copies of each of
its documents: a whole part, which every document gets, and a fractional part.
The fractions are rounded dependently. In a bucket of documents of one source,
a carried document meets the next one: an amount of words is moved from one to
the other, in a random direction whose odds keep each document's expectation,
until one of the two holds none or a full copy of itself. So the words that a
bucket takes stay what they were but for one unsettled document. The unsettled
documents of all buckets form the next, 1/64 as large, level of a reduction
tree. The single one that is left per source is rounded up with the probability that
its fraction names, so every document's expected copies are the source's rate, and a
source's words come within one document of its target. Sources of any size go this way.

Buckets are keyed by (source, hash of doc_id), so a source with a third of all
rows is as many small groups; per-source figures come from partial sums. Texts
are read once, for their word counts, and never shuffled.

Defined cases: null text has size 0 and takes 0 words; a null source is a
source of its own, the last one; rows that repeat a doc_id, or have none, are told
apart by their texts, and wholly equal rows are first rounded among themselves, by
their number; ties are broken by a hash of these, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.cluster import only, settled
from strandline.llm.quality_rules import _WS

BUCKET = 64
#: Rows that one element of an exploded group of wholly equal rows stands for.
ALIKE = 1000
#: A target is at most this many times its source's size.
MOST_COPIES = 3
SEED = 20_031


def n_words(text: Column) -> Column:
    """Number of words: pieces between white space, without the empty ones at both ends."""
    parts = F.split(F.coalesce(text, F.lit("")), _WS)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def targets(per_source: DataFrame) -> DataFrame:
    """source, n_docs, source_size -> also target: weights 1, 2, 3, ... capped, the excess reshared by weight.

    Sources fill up in the order of cap / weight. With the sources sorted that
    way, one is full exactly if its cap is at most its share of what the fuller ones
    leave, so running sums give all targets at once. There is one row per source here.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("weight", (F.row_number().over(in_order) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * MOST_COPIES)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0)))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(by_fill), F.lit(0)))
        .withColumn("full", F.col("cap") * F.col("rest_weight") <= F.col("rest") * F.col("weight"))
    )
    left = (
        filled.withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every))
        .withColumn("open_words", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)))
    )
    share = F.col("open_words") * F.col("weight") / F.col("open_weight")
    return left.select("source", "n_docs", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def _uniform(*of: Column) -> Column:
    return (F.xxhash64(F.lit(SEED), *of).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def _pivot(items: Column, level: int) -> Column:
    """Struct of the carried item and the settled ones of one bucket's array of (key, doc_id, size, p, ...)."""
    none = F.lit(None).cast("struct<key:bigint,doc_id:bigint,size:bigint,p:double,text_hash:bigint>")
    start = F.struct(none.alias("carry"), F.filter(items, lambda x: F.lit(False)).alias("done"))

    def with_p(x: Column, p: Column) -> Column:
        return x.withField("p", p)

    def step(acc: Column, x: Column) -> Column:
        a = acc["carry"]
        up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])  # words that can move to the carried one
        down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])  # and from it
        gain = _uniform(a["key"], x["key"], F.lit(level)) * (up + down) < down
        a_up_full = (1 - a["p"]) * a["size"] <= x["p"] * x["size"]
        a_down_out = a["p"] * a["size"] <= (1 - x["p"]) * x["size"]
        a_after = F.when(gain, F.when(a_up_full, F.lit(1.0)).otherwise(a["p"] + up / a["size"])).otherwise(F.when(a_down_out, F.lit(0.0)).otherwise(a["p"] - down / a["size"]))
        x_after = F.when(gain, F.when(a_up_full, x["p"] - up / x["size"]).otherwise(F.lit(0.0))).otherwise(F.when(a_down_out, x["p"] + down / x["size"]).otherwise(F.lit(1.0)))
        a_settles = F.when(gain, a_up_full).otherwise(a_down_out)
        return F.when(a.isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(
            F.struct(
                F.when(a_settles, with_p(x, x_after)).otherwise(with_p(a, a_after)).alias("carry"),
                F.concat(acc["done"], F.array(F.when(a_settles, with_p(a, a_after)).otherwise(with_p(x, x_after)))).alias("done"),
            )
        )

    return F.aggregate(items, start, step)


def _alike(open_: DataFrame, of: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that agree in everything, met among themselves first: (settled ones, one unsettled row for each).

    Of n such rows, as many take a copy as their fractions add up to in whole; one has what is left over.
    """
    groups = open_.groupBy(*of).agg(F.count(F.lit(1)).alias("n")).withColumn("full", F.floor(F.col("n") * F.col("p")))
    rest = groups.withColumn("p", F.col("n") * F.col("p") - F.col("full")).drop("n", "full")
    parts = groups.filter("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 2) / ALIKE))))
    first = F.col("part") * ALIKE
    each = parts.withColumn("i", F.explode(F.sequence(first, F.least(first + ALIKE, F.col("n") - 1) - 1)))
    return each.withColumn("p", F.when(F.col("i") < F.col("full"), 1.0).otherwise(0.0)), rest


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_key: bool = False, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row; ``with_key`` adds its source and text_hash."""
    rows = only(docs, doc_id=id_col, text=text_col, source=source_col).select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    rows = settled(rows)
    per_source = targets(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")))
    per_source = settled(per_source)
    most = per_source.agg(F.max("n_docs")).first()[0] or 0
    joined = rows.join(per_source.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of = ["source", "doc_id", "text_hash", "size", "source_size", "target", "whole", "p"]
    wanted = joined.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole")).select(*of, "n_docs")
    at_rest = (F.col("size") == 0) | (F.col("p") <= 0)
    finished = wanted.filter(at_rest).withColumn("p", F.lit(0.0)).select(*of)
    done, open_ = _alike(wanted.filter(~at_rest), [*of, "n_docs"])
    finished = finished.unionByName(done.select(*of))
    key = F.xxhash64("doc_id", "size", "text_hash", F.lit(seed))
    item = F.struct(key.alias("key"), "doc_id", "size", "p", "text_hash")
    per = ["source", "whole", "target", "source_size"]
    open_ = open_.select(*per, F.ceil(F.col("n_docs") / BUCKET).alias("n_buckets"), item.alias("item"))
    level = 0
    while most > 1:
        bucket = F.pmod(F.xxhash64(F.col("item.key"), F.lit(level)), F.col("n_buckets"))
        buckets = settled(
            open_.groupBy(*per, "n_buckets", bucket.alias("bucket"))
            .agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("item.size").alias("size"), "item")))).alias("items"))
            .select(*per, "n_buckets", _pivot(F.col("items.item"), level).alias("state"))
        )
        finished = finished.unionByName(buckets.select(*per, F.explode("state.done").alias("i")).select(*per, "i.doc_id", "i.text_hash", "i.size", "i.p"))
        open_ = buckets.select(*per, F.ceil(F.col("n_buckets") / BUCKET).alias("n_buckets"), F.col("state.carry").alias("item"))
        level, most = level + 1, open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    last = F.when(_uniform(F.col("item.key"), F.lit(-1)) < F.col("item.p"), 1.0).otherwise(0.0)
    finished = finished.unionByName(open_.select(*per, "item.doc_id", "item.text_hash", "item.size", last.alias("p")))
    copies = (F.col("whole") + F.round("p").cast("long")).cast("long")
    return finished.select(*["source", "text_hash"] * with_key, "doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
