"""A corpus pipeline over ``documents``: each stage applies one operator to all that came before.

language_id drops documents without a recognisable language; exact_dedup and
ngram_join keep one document of each group; source_mix repeats or leaves out documents
so that sources meet their target weights; sentencepiece encodes what the mix holds.
All stages but the last return the columns of ``documents``.

Edge cases: any column may be null and the table may be empty; the operators' own
rules hold (see their modules).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import exact_dedup, language, pieces, shingle_join, source_mix
from tidepool.llm.store import park


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the stage's own labelled rows."""
    return language.accepted(docs, language.fit_by_remainder(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the smallest doc_id stays."""
    return shingle_join.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes once for each pass that takes it."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, sampled pieces, their number, and whether decoding gave the text back."""
    return pieces.encode(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_join", near), ("source_mix", mixing), ("sentencepiece", encode)]

#: SQL expresses neither language identification nor sampled pieces; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = park(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
