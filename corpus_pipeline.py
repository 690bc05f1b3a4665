"""Corpus pipeline: documents to training sequences, in five stages.

Each stage works on all that the one before kept, is written as Parquet and read again.
All but the last return the columns of documents; the last returns the pieces of
documents with the sequence and offset that each is packed to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import language_id, line_dedup, mixing, near_dedup, packing
from corpusloom.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows know; undetermined ones go."""
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which nothing is left goes with them."""
    return line_dedup.without_repeats(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return near_dedup.without_near_duplicates(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens are dealt to sources by weight, no document twice."""
    return mixing.mix(docs, numerator=4, denominator=5, max_epochs=1).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language ID, registers and tokens are not SQL. A test holds each stage of run() against a
#: brute-force version on a small fixture (tests/llm/test_corpus.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
