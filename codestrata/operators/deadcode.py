"""Function definitions, identifier frequencies, and functions nobody names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.functions.arrow import count_identifiers
from codestrata.functions.text import RE_BLANK, lines
from codestrata.scale import fits_broadcast, materialize, unnest

IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"

# How a definition looks on a line, per language, with its name as the group.
DEFINITIONS = {
    "Python": rf"^{RE_BLANK}*def{RE_BLANK}+({IDENTIFIER}){RE_BLANK}*\(",
    "Go": rf"^{RE_BLANK}*func{RE_BLANK}+(?:\([^)]+\){RE_BLANK}+)?({IDENTIFIER}){RE_BLANK}*\(",
    "Java": rf"^{RE_BLANK}*(?:public{RE_BLANK}+|private{RE_BLANK}+|protected{RE_BLANK}+"
    rf"|static{RE_BLANK}+)*[A-Za-z0-9_<>\[\]]+{RE_BLANK}+({IDENTIFIER}){RE_BLANK}*\(",
}
OTHER_DEFINITION = (
    rf"^{RE_BLANK}*(?:function|async{RE_BLANK}+function){RE_BLANK}+({IDENTIFIER}){RE_BLANK}*\("
)

# Names that are called from outside and so never count as dead.
ENTRY_POINTS = ["main", "init", "String", "Error"]


def definition_names(text: Column, lang: Column) -> Column:
    """Lines that define a function: ``array<struct<line,name>>``."""

    def named(line: Column) -> Column:
        name = F.regexp_extract(line, OTHER_DEFINITION, 1)
        for language, pattern in DEFINITIONS.items():
            name = F.when(lang == language, F.regexp_extract(line, pattern, 1)).otherwise(name)
        return name

    found = F.transform(
        lines(text),
        lambda line, n: F.when(
            F.contains(line, F.lit("(")),
            F.struct((n + 1).alias("line"), named(line).alias("name")),
        ),
    )
    return F.filter(found, lambda item: item["name"] != "")


def name_counts(text: Column) -> Column:
    """Identifiers of a text, comments and strings included: ``array<struct<name,n>>``."""
    return count_identifiers(text)


def with_names(files: DataFrame) -> DataFrame:
    """Add ``definitions`` and ``names`` to ``(…, lang, text)``."""
    text, lang = F.col("text"), F.col("lang")
    return files.withColumns(
        {"definitions": definition_names(text, lang), "names": name_counts(text)}
    )


def definitions_of(files_with_names: DataFrame) -> DataFrame:
    """``(repo, path, line, name)`` of each line that defines a function."""
    return unnest(files_with_names, ["repo", "path"], F.inline_outer("definitions"), "line")


def identifier_frequency(files_with_names: DataFrame) -> DataFrame:
    """``(repo, name, n)``; a file's counts are added up in each task before the shuffle."""
    rows = unnest(files_with_names, ["repo"], F.inline_outer("names"), "name")
    return rows.groupBy("repo", "name").agg(F.sum("n").alias("n"))


def may_be_dead(found: DataFrame) -> DataFrame:
    """Definitions whose name is not an entry point, a test, a benchmark or an example."""
    name = F.col("name")
    return found.filter(
        ~name.isin(ENTRY_POINTS)
        & ~F.startswith(F.lower(name), F.lit("test"))
        & ~F.startswith(name, F.lit("Benchmark"))
        & ~F.startswith(name, F.lit("Example"))
    )


def first_k_per_repo(rows: DataFrame, k: int, order: list) -> DataFrame:
    """First ``k`` rows of each repository; every task trims to ``k`` before the shuffle."""
    place = F.row_number().over(W.partitionBy("repo").orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def dead_code(files_with_names: DataFrame) -> DataFrame:
    """``(repo, path, line, name)`` of all definitions whose name occurs once in the repository.

    Reads the names of stored facts, not texts.  A name that a file has twice is not dead.  Only
    names that are defined once can be; where these are few enough to broadcast, occurrences of
    other names are left out before the shuffle.
    """
    found = may_be_dead(definitions_of(files_with_names)).withColumn("n", F.lit(0))
    names = unnest(files_with_names, ["repo"], F.inline_outer("names"), "name")
    once = found.groupBy("repo", "name").agg(
        F.count(F.lit(1)).alias("defined"), F.min("path").alias("path"), F.min("line").alias("line")
    )
    once = materialize(once.filter("defined = 1").drop("defined"), "defined-once")
    if fits_broadcast(once):
        wanted = F.broadcast(once.select(F.col("repo").alias("r"), F.col("name").alias("d")))
        same = names.repo.eqNullSafe(wanted.r) & (names.name == wanted.d)
        uses = names.join(wanted, same, "left_semi").groupBy("repo", "name")
        single = uses.agg(F.sum("n").alias("n")).filter("n = 1")
        single = single.select(F.col("repo").alias("r"), F.col("name").alias("d"))
        same = once.repo.eqNullSafe(single.r) & (once.name == single.d)
        return once.join(single, same, "left_semi").select("repo", "path", "line", "name")
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in (("path", "string"), ("line", "int"))]
    # Definitions and occurrences meet in one aggregation, combined in each task.
    rows = found.select("repo", "name", "path", "line", "n").unionByName(
        names.select("repo", "name", *blank, "n")
    )
    return (
        rows.groupBy("repo", "name")
        .agg(
            F.sum("n").alias("n"),
            F.count("path").alias("defined"),
            F.min("path").alias("path"),
            F.min("line").alias("line"),
        )
        .filter("n = 1 AND defined = 1")
        .select("repo", "path", "line", "name")
    )
