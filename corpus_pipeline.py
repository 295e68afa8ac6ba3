"""From raw documents to token ids: quality, toxicity, near duplicates, decontamination, encoding.

Each stage gets a table with the columns of documents and returns one with the rows it keeps; the last returns ids.
Between stages the table is written and read again, so a lost executor costs one stage's tasks at most; a stage's table
goes when the next one has been written.

In every stage null and empty texts are empty texts, repeated rows are rows, columns beyond those named may have any name
and are kept as they are, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontamination, neardup, quality, toxicity
from tidemark.llm.common import remove, remove_at_end, shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within the thresholds from trusted text of their language (doc_id, text, lang).

    Empty texts have no n-grams but their end and stay with all of a length near zero; a null lang is a language of its
    own. Rows alike in doc_id and text share a verdict. Without enough trusted text in a language all its rows stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't count as toxic (doc_id, text), repeated rows each by themselves."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of smallest doc_id (null last); ties go by the text's hash. All
    empty texts are one class, and of repeated rows one stays."""
    return neardup.one_of_each(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited or not. Items without an id or of fewer than 8 words take no part."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, where pre-tokens begin among them, and digests of the ids and of what they
    decode to. Empty texts have no ids."""
    return bpe.encode_documents(docs, bpe.default_vocabulary())


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_unleaked),
    ("encoding", encode),
]

#: Stages of trained models and of tokens can't be had in SQL; tests hold each operator against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, place = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    remove_at_end(spark, place)
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if done is not None:
            remove(spark, done)
        done = f"{place}/{name}"
    return docs
