"""Everything the detectors need from a text, found in one pass over it."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.boundaries import import_targets
from codestrata.operators.deadcode import definition_names, name_counts
from codestrata.operators.naming import naming_styles
from codestrata.operators.patterns import PATTERN_RULES, rule_hits
from codestrata.operators.segment import function_blocks, god_functions
from codestrata.options import ScanOptions


@lru_cache(maxsize=8)
def _fact_columns(application: str, options: ScanOptions) -> tuple[Column, ...]:
    # Kept per application: putting these expressions together takes seconds, and a rescan
    # needs them for every batch.
    text, lang = F.col("text"), F.col("lang")
    names = [definition_names(text, lang).alias("definitions"), name_counts(text).alias("names")]
    return (
        function_blocks(text, lang, options.duplicate_min_lines).alias("blocks"),
        rule_hits(text, lang, (*PATTERN_RULES, *options.rules)).alias("hits"),
        god_functions(text, lang, options.god_function_lines).alias("god"),
        import_targets(text, lang).alias("imports"),
        naming_styles(text, lang).alias("naming"),
        *(names if options.dead_code else []),
    )


def file_facts(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """One row per file of ``(repo, path, lang, text)``, without its text.

    The facts of a file depend on nothing but the file, so the texts are read once and never
    shuffled; a changed file changes one row.  Names are only kept when dead code is asked for.
    """
    application = files.sparkSession.sparkContext.applicationId
    return files.select("repo", "path", "lang", *_fact_columns(application, options))
