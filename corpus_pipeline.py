"""Corpus pipeline: language, near duplicates, benchmark leaks, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. What a stage rejects is gone for the stages after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from labelq.llm import decontaminate, jaccard_join, language_id, mixing, token_store
from labelq.llm.base import table
from labelq.session import materialised, scratch_path

SHINGLE_WORDS, PERCENT = 5, 80


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language the evidence does not settle; the text model learns from their labels."""
    return language_id.accepted_documents(docs, docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group linked by near equal shingle sets."""
    return jaccard_join.one_of_each(docs, SHINGLE_WORDS, PERCENT)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), SHINGLE_WORDS, PERCENT)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and select documents to the sources' target weights; the better labelled come first."""
    return mixing.repeated(docs, table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store and return, from its files, where every document lies in it."""
    folder = scratch_path(spark, "token_ids")
    token_store.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_store.read_documents(spark, folder)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("decontaminate", free_of_benchmark),
    ("mix_sources", mixed_sources),
    ("token_ids", token_ids),
]

ORACLE_SQL = None  # the language model and the tokenizer have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
