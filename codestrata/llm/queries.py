"""Queries that apply each operator of this package to its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import (
    audit,
    chosen_path,
    hamming,
    jaccard,
    language,
    maxent,
    mixing,
    packing,
    preference,
    quality,
    resample,
    substring,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"), count_links=True)


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return preference.format_pairs(*preference.neighbours(turns))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_vectors(_table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("key")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_texts(_table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return resample.importance(documents, benchmark).drop("n_words")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chosen_path.similar_classes(_table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_preference": op4_preference,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_language": op6_language,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_substring": op9_substring,
    "op10_lm_scores": op10_lm_scores,
    "op11_resampling": op11_resampling,
    "op12_filter_audit": op12_filter_audit,
    "op13_chosen_path": op13_chosen_path,
}
