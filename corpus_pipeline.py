"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. Decisions return to the rows
by doc_id (null or not) and text, so rows that lack an id or repeat one are told
apart; only rows that agree in both share a fate. A group of copies without any id
stays whole, as no row of it is the one to keep. Every stage's result but the last has
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.cluster import documents, written
from strandline.llm.exact_dedup import exact_dedup
from strandline.llm.mixing import mix_sources
from strandline.llm.ngram_join import ngram_components
from strandline.llm.packing import best_fit_pack
from strandline.llm.quality_rules import quality_rules
from strandline.llm.queries import TOKENIZER
from strandline.session import ship

ORACLE_SQL = None  # rounding, packing and tokenisation are beyond SQL; a test compares the stages with plain Python


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules and base limits keep, without their failing lines."""
    ship(spark)
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    kept = quality_rules(whole, carry=["row"], with_text=True).filter("verdict_kept")
    new = {"text": F.col("cleaned_text"), "n_chars": F.char_length("cleaned_text").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose doc_id (null or not) and text aren't among the dropped (doc_id, text_hash)."""
    gone = dropped.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the rows with the largest id."""
    ship(spark)
    return _without(docs, exact_dedup(docs, with_hash=True).filter("not kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the rows with the smallest id."""
    ship(spark)
    return _without(docs, ngram_components(docs, with_hash=True).filter("component_id is not null and not (component_id <=> doc_id)"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to three times."""
    ship(spark)
    # Rows of a key are alike to the mix and differ by one copy at most, so it only matters how many have one more.
    key = ("doc_id", "source", "text_hash")  # of structs, null parts are equal
    copies = mix_sources(docs, with_key=True).groupBy(F.struct(*key).alias("mix_key")).agg(F.min("copies").alias("least"), F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("rows"))
    copies = copies.filter("sum > 0").select("mix_key", "least", (F.col("sum") - F.col("least") * F.col("rows")).alias("more"))
    mix_key = F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")).alias("mix_key")
    place = F.row_number().over(Window.partitionBy("mix_key").orderBy("row.lang", "row.n_chars"))
    taken = docs.select(mix_key, F.struct(*docs.columns).alias("row")).join(copies, "mix_key").withColumn("place", place)
    times = (F.col("least") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)).cast("int")
    taken = taken.withColumn("times", times).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    ship(spark)
    return best_fit_pack(docs, TOKENIZER)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
