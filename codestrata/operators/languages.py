"""Language of each repository, and the source files that belong to it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions.paths import (
    components,
    exclude_regexes,
    extension,
    in_skipped_directory,
    is_excluded,
)
from codestrata.options import ScanOptions
from codestrata.scale import attach, materialize
from codestrata.schema import DETECTED_EXTENSIONS, SOURCE_EXTENSIONS, UNKNOWN

# Patterns are translated in tasks, whose machines need no copy of this package.
cloudpickle.register_pickle_by_value(paths)


def language_of(extension_: Column, known: dict[str, str]) -> Column:
    pairs = [F.lit(value) for pair in known.items() for value in pair]
    return F.try_element_at(F.create_map(*pairs), extension_)


def drop_skipped(files: DataFrame) -> DataFrame:
    return files.filter(~in_skipped_directory(F.col("path"), F.col("repo")))


def drop_excluded(files: DataFrame, patterns: tuple[str, ...] | list[str]) -> DataFrame:
    return files.filter(~is_excluded(F.col("path"), patterns)) if patterns else files


def compiled_excludes(excludes: DataFrame) -> DataFrame:
    """``(repo, whole, part)`` of ``(repo, pattern)``: a regex of paths, and one of components.

    A row for each repository that has patterns, with all of its own as alternatives, so that a
    task compiles them once while it sees files of that repository.
    """

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [exclude_regexes(pattern) for pattern in batch["pattern"]]
            wholes, parts = zip(*pairs) if pairs else ((), ())
            yield pd.DataFrame({"repo": batch["repo"], "whole": wholes, "part": parts}, dtype=object)

    given = excludes.filter("pattern IS NOT NULL").select("repo", "pattern").distinct()
    rows = given.mapInPandas(compiled, "repo string, whole string, part string")
    either = (F.array_join(F.collect_list(name), "|").alias(name) for name in ("whole", "part"))
    some = (F.count(name).alias(f"{name}s") for name in ("whole", "part"))
    found = rows.groupBy("repo").agg(*either, *some)
    whole, part = (F.when(F.col(f"{name}s") > 0, F.col(name)) for name in ("whole", "part"))
    return found.select("repo", whole.alias("whole"), part.alias("part"))


def drop_excluded_by_repo(files: DataFrame, excludes: DataFrame) -> DataFrame:
    """Files that no exclude pattern of their own repository hits.

    ``excludes`` is ``(repo, pattern)``, a row for each pattern; patterns mean what they mean in
    `drop_excluded`.  Repositories without patterns keep all files; only hot ones are treated apart
    where there are too many to broadcast.
    """
    counts = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_paths"))
    known = counts.join(compiled_excludes(excludes), "repo", "left")
    joined = attach(files, materialize(known, "excludes"), ["repo"], "n_paths")
    whole = F.coalesce(F.rlike(F.col("path"), F.col("whole")), F.lit(False))
    inside = F.exists(components(F.col("path")), lambda part: F.rlike(part, F.col("part")))
    return joined.filter(~whole & ~F.coalesce(inside, F.lit(False))).select(*files.columns)


def _directories_with_extension(files: DataFrame) -> DataFrame:
    """Directories whose own name ends like a source file, one row each."""
    parts = components(F.col("path"))
    ends = F.array(*[F.lit(e) for e in DETECTED_EXTENSIONS])
    candidates = files.filter(
        F.lower("path").rlike(
            "(?:" + "|".join(e.replace(".", r"\.") for e in DETECTED_EXTENSIONS) + ")/"
        )
    )
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return (
        candidates.filter(F.size(parts) > 1)
        .select("repo", F.explode(prefixes).alias("path"))
        .filter(F.array_contains(ends, extension(F.col("path"))))
        .distinct()
    )


def detect_language(files: DataFrame) -> DataFrame:
    """``(repo, language, n_files)``: the most frequent language of each repository.

    Reads ``repo`` and ``path`` only.  Ties go to the first name.  ``n_files`` counts all files
    of the repository.  A repository without a known extension is ``Unknown``.
    """
    paths = files.select("repo", "path")
    visible = drop_skipped(paths)
    named = visible.unionByName(_directories_with_extension(visible))
    language = language_of(extension(F.col("path")), DETECTED_EXTENSIONS)
    counts = (
        paths.select("repo", F.lit(None).cast("string").alias("lang"), F.lit(1).alias("one"))
        .unionByName(named.select("repo", language.alias("lang"), F.lit(0).alias("one")))
        .groupBy("repo", "lang")
        .agg(F.count("lang").alias("n"), F.sum("one").alias("files"))
    )
    best = F.min_by(
        "lang", F.when(F.col("lang").isNotNull(), F.struct(-F.col("n"), F.col("lang")))
    )
    return counts.groupBy("repo").agg(
        F.coalesce(best, F.lit(UNKNOWN)).alias("language"), F.sum("files").alias("n_files")
    )


def candidate_files(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Files a scan may read, with the language of their own extension as ``lang``."""
    lang = language_of(extension(F.col("path")), SOURCE_EXTENSIONS)
    kept = drop_excluded(drop_skipped(files), options.exclude)
    return kept.withColumn("lang", lang).filter(F.col("lang").isNotNull())


def in_language(rows: DataFrame, languages: DataFrame) -> DataFrame:
    """Rows whose ``lang`` is the language of their repository.

    ``languages`` should be a stored table.  Up to a counted number of repositories it is
    broadcast and ``rows`` are not shuffled; beyond that those of hot repositories are not.
    """
    joined = attach(rows, languages, ["repo"], "n_files")
    return joined.filter(F.col("lang") == F.col("language")).drop("language", "n_files")


def source_files(
    files: DataFrame, languages: DataFrame, options: ScanOptions = ScanOptions()
) -> DataFrame:
    """Candidate files in the language of their repository."""
    return in_language(candidate_files(files, options), languages)
