"""What is derived from violations: counts, score, gate, rankings, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.paths import components
from codestrata.functions.text import first_sentence
from codestrata.operators.deadcode import first_k_per_repo
from codestrata.operators.patterns import RULES, WHAT_TO_DO
from codestrata.schema import (
    ANTI_PATTERN,
    BOUNDARY,
    CRITICAL,
    DUPLICATION,
    INFO,
    PENALTY,
    SEVERITIES,
    VIOLATION_ORDER,
    WARNING,
)


def severity_rank(severity: Column) -> Column:
    ranks = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.array_position(ranks, severity).cast("int")


def order_columns() -> list[Column]:
    """Sort keys that put the violations of a repository in detection order."""
    return [
        components(F.col("path")) if name == "path" else F.col(name) for name in VIOLATION_ORDER
    ]


def summary(repos: DataFrame, violations: DataFrame) -> DataFrame:
    """One row per repository with every count the other results need."""

    def count_where(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    counts = violations.groupBy("repo").agg(
        F.count(F.lit(1)).alias("violation_count"),
        count_where("severity", CRITICAL).alias("criticals"),
        count_where("severity", WARNING).alias("warnings"),
        count_where("severity", INFO).alias("infos"),
        count_where("category", DUPLICATION).alias("duplicate_sets"),
        count_where("category", BOUNDARY).alias("broken_boundaries"),
        count_where("category", ANTI_PATTERN).alias("anti_patterns"),
    )
    return repos.join(counts, "repo", "left").na.fill(
        0, [name for name in counts.columns if name != "repo"]
    )


def stats(summary_: DataFrame) -> DataFrame:
    return summary_.select(
        "repo",
        "total_files",
        "violation_count",
        "duplicate_sets",
        "broken_boundaries",
        "anti_patterns",
    )


def score_of() -> Column:
    """100 less a penalty per violation, not below 0; 100 where no file was scanned."""
    lost = (
        F.col("criticals") * PENALTY[CRITICAL]
        + F.col("warnings") * PENALTY[WARNING]
        + F.col("infos") * PENALTY[INFO]
    )
    return F.when(F.col("total_files") == 0, F.lit(100).cast("long")).otherwise(
        F.greatest(F.lit(0).cast("long"), F.lit(100) - lost)
    )


def score_label(score: Column) -> Column:
    # The labels and where they begin.
    return (
        F.when(score < 40, "Critical Drift")
        .when(score < 70, "Degraded")
        .when(score < 85, "Fair")
        .otherwise("Excellent")
    )


def health_score(summary_: DataFrame) -> DataFrame:
    return summary_.select("repo", score_of().alias("score")).withColumn(
        "label", score_label(F.col("score"))
    )


def gate(summary_: DataFrame) -> DataFrame:
    """``failed``: the repository has a critical violation."""
    return summary_.select("repo", (F.col("criticals") > 0).alias("failed"))


def suggestions_of() -> Column:
    """What there is to do: the number of findings of each kind that has any."""
    kinds = [
        ("duplicate_sets", "copied functions to merge"),
        ("broken_boundaries", "imports to reroute"),
        ("anti_patterns", "risky places to rewrite"),
    ]
    listed = [
        F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(f" {what}")))
        for name, what in kinds
    ]
    return F.filter(F.array(*listed), lambda text: text.isNotNull())


def suggestions(summary_: DataFrame) -> DataFrame:
    return summary_.select("repo", suggestions_of().alias("suggestions"))


def remedy_of() -> Column:
    """What to do about a violation: its rule's own remedy where its suggestion is the common one."""
    remedies = {rule.rule_id: F.lit(rule.remedy) for rule in RULES}
    remedies["layer-boundary"] = F.format_string(
        "Declare an interface in the %s layer and have the implementation passed in.",
        F.substring_index("title", " into ", -1),
    )
    suggestion = F.col("suggestion")
    return F.coalesce(
        *[F.when(suggestion == WHAT_TO_DO % rule_id, text) for rule_id, text in remedies.items()],
        suggestion,
    )


def by_severity(violations: DataFrame) -> DataFrame:
    """All violations in report order: repository, severity, then detection order."""
    return violations.orderBy(
        "repo", severity_rank(F.col("severity")), *order_columns()
    )


def worst_offenders(refs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` files with most references, for repositories with at least two such files.

    Counts are combined before the shuffle and each task keeps ``k`` files per repository, so
    the last step sees at most ``k`` rows of each.
    """
    counts = (
        refs.groupBy("repo", F.col("ref_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = first_k_per_repo(counts, k, [F.col("n").desc(), F.col("file")])
    files = F.count(F.lit(1)).over(W.partitionBy("repo"))
    return top.withColumn("files", files).filter("files >= 2").drop("files")


def guardrail_rules(violations: DataFrame) -> DataFrame:
    """Distinct rules by category and title; the first violation of each gives the text."""
    place = F.struct(*order_columns())
    first = F.min_by(
        F.struct(*VIOLATION_ORDER, "description", "suggestion"), place
    )
    return (
        violations.groupBy("repo", "category", "title")
        .agg(first.alias("first"))
        .select(
            "repo",
            "category",
            "title",
            first_sentence(F.col("first.description")).alias("reason"),
            F.col("first.suggestion").alias("required"),
            *[F.col(f"first.{name}").alias(name) for name in VIOLATION_ORDER],
        )
    )


def language_conventions(repos: DataFrame, conventions: DataFrame) -> DataFrame:
    """``(repo, language, conventions)`` from a given table ``(language, text)``.

    The table has a row for each language, a bounded number; a language without one gives null.
    """
    given = conventions.select("language", F.col("text").alias("conventions"))
    return repos.join(F.broadcast(given), "language", "left").select("repo", "language", "conventions")
