"""A corpus from raw documents: language, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents, in their order, and drop any others. Stages are meant to be written and read again in
between, as ``run`` does. An empty table goes through every stage and stays empty. Whole texts are
read, of any length; columns that others of a stage could clash with (``row``, ``mark``, ``key``) may be
there and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import langid, mixing, near_copies, packing, pii
from loomspark.llm.common import materialize, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be learned from the labels; the others go.

    Null and empty texts and texts without a letter are in none and go; a null lang is filled in, one
    that is there is kept. Without any labelled text no document stays. Repeated rows are judged alike.
    """
    docs = docs.select(*COLUMNS)
    return langid.accept(docs, langid.train(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link at a Jaccard likeness of 0.8 or more.

    SimHash blocks and min-hash bands nominate pairs, the shingles decide each. The smallest doc_id stays,
    then the smallest hash of the text; a null doc_id only where its group has no other, and of wholly
    equal rows one. Null, empty and blank texts are alike and leave one row.
    """
    return near_copies.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked by their kind in angle brackets; no row goes.

    Null stays null, empty stays empty; n_chars is counted again. Overlapping spans are masked once.
    """
    return pii.redact(docs.select(*COLUMNS), pii.train())


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole and in part, towards the target weights of their sources.

    A null source is a source of its own, the last. Texts without words have nothing to give and go.
    Ties of the seeded order go by doc_id and size; repeated rows take their turns each.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 ids: one row a piece.

    Null and empty texts are one end id each. Every row, repeated ones too, is packed once.
    """
    return packing.pack_documents(docs, packing.default_vocabulary())


STAGES = [
    ("languages", languages),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packed", packed),
]

#: Hashing, boosted trees and subword ids have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each but the last written and read again."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
