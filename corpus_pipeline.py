"""A corpus pipeline over ``documents``: stages written as Parquet and read again, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wagelens.llm import bpe, langid, mixing, neardup, pii
from wagelens.llm.common import cut, fold, prepare, table

#: Not expressible in SQL: compression, darts and BPE. Tested against a brute-force version (tests/llm).
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID by compression: documents that it rejects go (no letters, or no language ahead)."""
    prepare(spark)
    return langid.accepted(docs, langid.learn(docs, fold(F.col("doc_id"), 4) != 2))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates by DartMinHash: the document of the least id of each group stays."""
    prepare(spark)
    return neardup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: every span found is replaced by its kind; ``n_chars`` follows the text."""
    prepare(spark)
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a document is there as often as the mix draws it, in shuffled shards."""
    prepare(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every row of the mix, digested."""
    prepare(spark)
    return bpe.encode_digest(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mix", mix),
          ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
