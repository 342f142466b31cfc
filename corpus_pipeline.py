"""The corpus pipeline: from raw documents to packed token sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the next one reads what was
written of it.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import jaccard, language, mixing, packing, substring
from codestrata.scale import materialize


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null ones and those without a letter go."""
    return language.keep_identified(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return jaccard.one_of_each(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur more than once."""
    shorter = substring.replace_texts(docs)
    if "n_chars" not in docs.columns:
        return shorter
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return shorter.withColumn("n_chars", n_chars)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("jaccard_join", different),
    ("substring_dedup", without_passages),
    ("mixing", mixed),
    ("packing", packed),
]

# Language identification and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)
