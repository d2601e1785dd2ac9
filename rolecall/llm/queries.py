"""The registered queries of this subpackage: one thin query for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, collocations, graph_search, language_id, lexical_search, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules, sharding, token_counts, url_filters


def _vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of a page is that of the document with the page's number."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filters.label_outcomes(labels))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts.count_tokens(docs, _vocabulary_path())


def op3_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return graph_search.nearest_neighbours(table, F.col("vec_id") % 100 == 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ratings = quality_classifier.quality_grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.classify(docs, quality_classifier.train(docs, ratings, n_grades=3), tail_from=2)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_codec.digests(bpe_codec.round_trip(docs, _vocabulary_path()))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary_path())


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_graph_search": op3_graph_search,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_sharding": op6_sharding,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_ngram_join": op9_ngram_join,
    "op10_mixing": op10_mixing,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op1_url_filters": url_filters.oracle_sql(), "op9_ngram_join": ngram_join.oracle_sql(), "op12_lexical_search": lexical_search.oracle_sql(), "op13_collocations": collocations.oracle_sql()}
