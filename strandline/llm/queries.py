"""The queries of this subpackage by name; each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm.cluster import documents
from strandline.llm.exact_dedup import exact_dedup
from strandline.llm.language_id import language_id
from strandline.llm.lm_scoring import lm_scores
from strandline.llm.mixing import mix_sources
from strandline.llm.ngram_join import ngram_components
from strandline.llm.packing import best_fit_pack
from strandline.llm.quality_classifier import quality_classifier
from strandline.llm.quality_rules import quality_rules
from strandline.llm.sql import ORACLES  # noqa: F401
from strandline.llm.substring_dedup import substring_dedup
from strandline.llm.token_counts import token_counts

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), TOKENIZER)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op8_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir), TOKENIZER)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_quality_classifier, op4_substring_dedup, op5_mix_sources, op6_token_counts, op7_exact_dedup, op8_best_fit_pack, op9_lm_scores, op10_ngram_join)}
