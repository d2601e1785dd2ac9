"""The corpus pipeline: quality, language, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns
the columns of documents; the last returns one row of tokens for each document that it gets.
Every stage takes an empty table (and returns one), further columns of any name (and keeps them,
but for the last), null ids and repeated rows; what becomes of them is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rolecall.llm import bpe_codec, language_id, mixing, ngram_join, quality_classifier
from rolecall.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are likelier toxic or of low quality than good.

    Null texts and those without a word go.  Rows are judged by text alone, so equal texts share
    their fate, and null ids and repeated rows stay as they are; one row of a repeated rated id
    is learned from.  Without two kinds of grades all texts with a word stay.
    """
    ratings = quality_classifier.quality_grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, ratings, n_grades=3), tail_from=2)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, or whose language is too uncertain.

    Null and empty texts go.  Rows are judged by text alone; rows with a null id or lang are judged
    like others, but not learned from.  Where no language was learned all go; where one was, all
    texts with a letter stay.
    """
    return language_id.keep_known(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the row with the least id.

    Of exactly repeated rows one stays; where an id comes with two texts each goes or stays by
    its own.  Rows with a null id or without a word are in no group and stay.
    """
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, some of them repeatedly, so that the sources' words meet their targets.

    Null and empty texts have no words and are not taken; a null source is a source.  Rows come
    out with their own columns, as often as they are taken; what exactly repeated rows are taken
    for is given to one of them, so reruns agree.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed), and digests of the ids and of the text decoded from them.

    One row for each row; a null text counts as empty and has no tokens; a null id stays null.
    """
    coded = bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return bpe_codec.digests(coded, "ids")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: SQL can't express the trained stages; tests compare each stage, and the whole, with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
