"""A training corpus from documents: language, near copies, shared passages, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of documents.  run() writes each
stage's documents as Parquet and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import copies, language, mixing, pieces, substrings
from keelson.llm.store import drop, fresh, put, scratch


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return language.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies."""
    return copies.keep_representatives(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that a document of a lesser id has too."""
    return substrings.cut_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces' ids, and `position`, which ascends in training order."""
    return pieces.encode(mixing.placed(docs))


STAGES = [("language_id", languages), ("simhash_dedup", near_copies), ("substring_dedup", passages), ("mixing", mixture), ("sentencepiece", tokens)]
#: Automata, XXH64, hash order and pieces have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    was = None
    for name, stage in STAGES:
        # what a stage wrote for itself goes when its documents are written, those when the next ones are
        at = fresh(spark, name)
        with scratch(spark):
            docs = put(stage(spark, docs, sf_dir), at)
        if was:
            drop(spark, was)
        was = at
    return docs
