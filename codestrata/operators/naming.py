"""Repositories that mix naming styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import components
from codestrata.functions.text import RE_SPACE
from codestrata.operators.deadcode import first_k_per_repo

# Patterns of the styles, and the counts that matter.
CAPS_CONSTANT = rf"const{RE_SPACE}+[A-Z_]{{3,}}{RE_SPACE}*="
CAMEL_CONSTANT = rf"const{RE_SPACE}+[A-Z][a-z]+[A-Z]"
CAMEL_FUNCTION = (
    rf"(?md)^def{RE_SPACE}+([a-z][a-zA-Z0-9]*[A-Z][a-zA-Z0-9]*){RE_SPACE}*\("
)
SNAKE_FUNCTION = rf"(?md)^def{RE_SPACE}+([a-z][a-z0-9_]+){RE_SPACE}*\("
MIN_FILES = 5
SNAKE_MORE_THAN = 2
EXAMPLES = 3


def naming_styles(text: Column, lang: Column) -> Column:
    """Styles in a file: ``struct<caps,camel,camel_functions,snake_functions>``."""
    go = F.when(lang == "Go", text)
    python = F.when(lang == "Python", text)

    def names(pattern: str) -> Column:
        return F.regexp_extract_all(python, F.lit(pattern), F.lit(1))

    return F.struct(
        go.rlike(CAPS_CONSTANT).alias("caps"),
        go.rlike(CAMEL_CONSTANT).alias("camel"),
        names(CAMEL_FUNCTION).alias("camel_functions"),
        names(SNAKE_FUNCTION).alias("snake_functions"),
    )


def with_naming(files: DataFrame) -> DataFrame:
    """Add ``naming`` to ``(…, lang, text)``."""
    return files.withColumn("naming", naming_styles(F.col("text"), F.col("lang")))


def naming_go(facts: DataFrame, min_files: int = MIN_FILES) -> DataFrame:
    """``(repo, caps_files, camel_files)`` of Go repositories that use both constant styles."""
    return (
        facts.filter("lang = 'Go'")
        .groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.count_if("naming.caps").alias("caps_files"),
            F.count_if("naming.camel").alias("camel_files"),
        )
        .filter((F.col("n_files") >= min_files) & (F.col("caps_files") > 0))
        .filter("camel_files > 0")
        .drop("n_files")
    )


def python_names(facts: DataFrame, first: int | None = None) -> DataFrame:
    """``(repo, path, style, pos, name)``: every function name in one of the two styles.

    With ``first`` only so many of each file.
    """

    def names(style: str) -> Column:
        every = F.col(f"naming.{style}_functions")
        return every if first is None else F.slice(every, 1, first)

    listed = [
        facts.filter("lang = 'Python'").select(
            "repo",
            "path",
            F.lit(style).alias("style"),
            F.posexplode(names(style)).alias("pos", "name"),
        )
        for style in ("camel", "snake")
    ]
    return listed[0].unionByName(listed[1])


def naming_python(facts: DataFrame, min_files: int = MIN_FILES) -> DataFrame:
    """``(repo, camel, snake, camel_examples, snake_examples)`` of mixed Python repositories.

    The examples are a few to show; `python_names` has all names.
    """
    python = facts.filter("lang = 'Python'")
    counts = (
        python.groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum(F.size("naming.camel_functions")).alias("camel"),
            F.sum(F.size("naming.snake_functions")).alias("snake"),
        )
        .filter((F.col("n_files") >= min_files) & (F.col("camel") > 0))
        .filter(F.col("snake") > SNAKE_MORE_THAN)
        .drop("n_files")
    )
    result = counts
    # Names stand by path and place: no file has more of the first ones than its own first.
    leading = python_names(facts, EXAMPLES)
    for style in ("camel", "snake"):
        names = leading.filter(F.col("style") == style)
        shown = first_k_per_repo(
            names, EXAMPLES, [components(F.col("path")), F.col("pos")]
        )
        # At most EXAMPLES rows per repository are left to gather.
        listed = shown.groupBy("repo").agg(
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.collect_list(F.struct(components(F.col("path")), "pos", "name"))
                    ),
                    lambda row: row["name"],
                ),
                ", ",
            ).alias(f"{style}_examples")
        )
        result = result.join(listed, "repo", "left")
    return result
