"""The scan: detectors over file facts, united into violations and their references."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.boundaries import crossing_imports
from codestrata.operators.deadcode import dead_code
from codestrata.operators.duplicates import duplicate_blocks, severity_of_copies
from codestrata.operators.languages import (
    candidate_files,
    detect_language,
    drop_excluded_by_repo,
    in_language,
    source_files,
)
from codestrata.operators.naming import naming_go, naming_python
from codestrata.operators.patterns import RULE_NO, RULES, WHAT_TO_DO, all_refs, hits_of
from codestrata.operators.segment import god_functions_of
from codestrata.options import ScanOptions
from codestrata.plans.facts import file_facts
from codestrata.scale import fits_broadcast, materialize
from codestrata.schema import (
    ANTI_PATTERN,
    BOUNDARY,
    CRITICAL,
    DEAD_CODE,
    DETECTORS,
    DUPLICATION,
    LAYERS,
    NAMING,
    REF_COLUMNS,
    REFS,
    VIOLATION_COLUMNS,
    VIOLATION_ORDER,
    VIOLATIONS,
    WARNING,
)

Found = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class Scan:
    """Tables of one scan, all keyed by ``repo``."""

    repos: DataFrame
    violations: DataFrame
    refs: DataFrame


def _violations(rows: DataFrame, category: str, **columns: Column) -> DataFrame:
    fixed = {
        "detector": F.lit(DETECTORS[category]),
        "category": F.lit(category),
        "path": F.col("path"),
        "rule_no": F.lit(0),
        "line": F.lit(0),
        "n_refs": F.lit(1).cast("long"),
    }
    values = {"repo": F.col("repo"), **fixed, **columns}
    more = [name for name in columns if name not in VIOLATION_COLUMNS]
    return rows.select(*[values[name].alias(name) for name in VIOLATION_COLUMNS + more])


def _with_refs(found: DataFrame, ref_lists: Column) -> Found:
    """Violations, and their references out of one list per row, as rows."""
    refs = found.select(
        "repo", "severity", *VIOLATION_ORDER, F.posexplode(ref_lists).alias("ref_no", "ref")
    )
    refs = refs.withColumn("ref_path", F.substring_index("ref", ":", 1))
    refs = refs.withColumn("ref_at", F.lit(""))
    return found.select(*VIOLATION_COLUMNS), refs.select(*REF_COLUMNS)


def detect_duplicates(facts: DataFrame, options: ScanOptions) -> Found:
    """One violation per group of copies; its references are rows, however many there are."""
    groups, places = duplicate_blocks(facts)
    key = F.concat(F.lit("duplicate:"), F.col("hash"))
    violations = _violations(
        groups.withColumn("path", F.lit("")),
        DUPLICATION,
        vkey=key,
        rule_id=F.lit("duplicate-block"),
        severity=severity_of_copies(F.col("n")),
        title=F.format_string("Same function body in %d places", "n"),
        description=F.concat(
            F.lit("Functions with the same normalised text were found.\n\nStart of the text:\n"),
            F.col("preview"),
        ),
        suggestion=F.lit("Keep one copy in a shared place and call it."),
        n_refs=F.col("n"),
    )
    refs = places.select(
        "repo",
        severity_of_copies(F.col("n")).alias("severity"),
        F.lit(DETECTORS[DUPLICATION]).alias("detector"),
        F.lit("").alias("path"),
        F.lit(0).alias("rule_no"),
        F.lit(0).alias("line"),
        key.alias("vkey"),
        F.col("path").alias("ref_at"),
        F.col("line").alias("ref_no"),
        F.col("path").alias("ref_path"),
        F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("ref"),
    )
    return violations, refs


def detect_patterns(facts: DataFrame, options: ScanOptions) -> Found:
    """One violation per file and rule."""

    def text_of(field: str) -> Column:
        values = [F.lit(getattr(rule, field)) for rule in (*RULES, *options.rules)]
        return F.get(F.array(*values), F.col("rule_no"))

    rows = hits_of(facts)
    refs = all_refs(F.col("path"), F.col("lines"))
    rows = rows.withColumn("rule_id", text_of("rule_id"))
    key = F.concat(F.col("rule_id"), F.lit(":"), F.col("path"))
    found = _violations(
        rows,
        ANTI_PATTERN,
        vkey=key,
        rule_no=F.col("rule_no"),
        rule_id=F.col("rule_id"),
        severity=text_of("severity"),
        title=text_of("title"),
        description=text_of("description"),
        suggestion=text_of("suggestion"),
        n_refs=F.size(refs).cast("long"),
        refs=refs,
    )
    return _with_refs(found, F.col("refs"))


def detect_god_functions(facts: DataFrame, options: ScanOptions) -> Found:
    """At most one violation per file."""
    rule = RULES[RULE_NO["god-function"]]
    rows = god_functions_of(facts)
    found = _violations(
        rows,
        ANTI_PATTERN,
        vkey=F.concat(F.lit("god-function:"), F.col("path")),
        rule_no=F.lit(RULE_NO["god-function"]),
        line=F.col("line"),
        rule_id=F.lit("god-function"),
        severity=F.lit(rule.severity),
        title=F.format_string("Function `%s` is %d lines long", "name", "length"),
        description=F.format_string(
            f"`%s` in %s takes %d lines, the limit is {options.god_function_lines}.\n"
            "Long functions tend to do several things.",
            "name",
            "path",
            "length",
        ),
        suggestion=F.lit(rule.suggestion),
    )
    return _with_refs(
        found, F.array(F.concat("path", F.lit(":"), F.col("line").cast("string")))
    )


def detect_naming(facts: DataFrame, options: ScanOptions) -> Found:
    """At most one violation per repository."""
    go = naming_go(facts, options.naming_min_files).withColumn("path", F.lit(""))
    mixed_constants = _violations(
        go,
        NAMING,
        vkey=F.lit("naming-go"),
        rule_id=F.lit("naming-go"),
        severity=F.lit(WARNING),
        title=F.lit("Constants named in two styles"),
        description=F.format_string(
            "%d files declare constants in capitals and %d in camel case.\n"
            "Go code uses camel case.",
            "caps_files",
            "camel_files",
        ),
        suggestion=F.lit("Rename the constants in capitals."),
    )
    python = naming_python(facts, options.naming_min_files).withColumn("path", F.lit(""))
    mixed_functions = _violations(
        python,
        NAMING,
        vkey=F.lit("naming-python"),
        rule_id=F.lit("naming-python"),
        severity=F.lit(WARNING),
        title=F.format_string(
            "Functions named in two styles: %d camel case, %d snake case", "camel", "snake"
        ),
        description=F.format_string(
            "PEP 8 asks for snake case.\nCamel case: %s\nSnake case: %s",
            "camel_examples",
            "snake_examples",
        ),
        suggestion=F.lit("Rename the functions in camel case."),
    )
    return _with_refs(
        mixed_constants.unionByName(mixed_functions), F.array(F.lit("multiple files"))
    )


def detect_boundaries(facts: DataFrame, options: ScanOptions) -> Found:
    """One violation per forbidden import."""
    forbidden = None
    if options.forbidden:
        schema = "from_layer string, to_layer string"
        forbidden = facts.sparkSession.createDataFrame(list(options.forbidden), schema)
    rows = crossing_imports(facts, options.root, options.layers or LAYERS, forbidden)
    found = _violations(
        rows,
        BOUNDARY,
        vkey=F.concat(F.lit("boundary:"), F.col("path"), F.lit(":"), F.col("ord").cast("string")),
        line=F.col("ord"),
        rule_id=F.lit("layer-boundary"),
        severity=F.lit(CRITICAL),
        title=F.format_string("Import from %s into %s", "to_layer", "from_layer"),
        description=F.format_string(
            "`%s` is in the %s layer and imports straight from the %s layer.\n"
            "The layers in between are skipped.",
            "path",
            "from_layer",
            "to_layer",
        ),
        suggestion=F.lit(WHAT_TO_DO % "layer-boundary"),
    )
    return _with_refs(found, F.array("path"))


def detect_dead_code(facts: DataFrame, options: ScanOptions) -> Found:
    """Functions whose name occurs once; needs facts with names."""
    rows = dead_code(facts)
    found = _violations(
        rows,
        DEAD_CODE,
        vkey=F.format_string("dead-code:%s:%d", "path", "line"),
        line=F.col("line"),
        rule_id=F.lit("dead-code"),
        severity=F.lit(WARNING),
        title=F.format_string("No use of function %s", "name"),
        description=F.format_string(
            "'%s' is defined, and its name occurs nowhere else in the repository.", "name"
        ),
        suggestion=F.lit("Delete it, or call it where it was meant to be called."),
    )
    return _with_refs(
        found, F.array(F.concat("path", F.lit(":"), F.col("line").cast("string")))
    )


# The extension point: a detector maps facts and options to violations and references.
Detector = Callable[[DataFrame, ScanOptions], Found]


def detectors(options: ScanOptions) -> list[Detector]:
    chosen: list[Detector] = []
    if options.duplication:
        chosen.append(detect_duplicates)
    if options.anti_patterns:
        chosen += [detect_patterns, detect_god_functions]
    if options.naming:
        chosen.append(detect_naming)
    if options.boundaries:
        chosen.append(detect_boundaries)
    if options.dead_code:
        chosen.append(detect_dead_code)
    return chosen


def scan_facts(
    facts: DataFrame,
    repos: DataFrame,
    options: ScanOptions = ScanOptions(),
    further: Sequence[Detector] = (),
) -> Scan:
    """Run the detectors over stored facts and unite what they find, which may be nothing.

    ``further`` detectors run behind those of ``options``.
    """
    spark = facts.sparkSession
    violations = spark.createDataFrame([], VIOLATIONS)
    refs = spark.createDataFrame([], REFS)
    for detect in (*detectors(options), *further):
        more_violations, more_refs = detect(facts, options)
        violations = violations.unionByName(more_violations)
        refs = refs.unionByName(more_refs)
    return Scan(repos, violations, refs)


def count_sources(languages: DataFrame, facts: DataFrame) -> DataFrame:
    """``(repo, language, total_files)``: files that were scanned, 0 where there are none."""
    counts = facts.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"))
    return languages.join(counts, "repo", "left").select(
        "repo", "language", F.coalesce("total_files", F.lit(0)).alias("total_files")
    )


def scan(
    files: DataFrame,
    options: ScanOptions = ScanOptions(),
    excludes: DataFrame | None = None,
    further: Sequence[Detector] = (),
) -> Scan:
    """Scan a corpus ``(repo, path, text)`` of any number of repositories.

    ``excludes`` is a table ``(repo, pattern)`` of what single repositories leave out, on top of the
    patterns of ``options``; languages are detected from all files.  Stored on the way: the languages, and the file facts, which replace the texts.
    """
    languages = materialize(detect_language(files), "languages")
    if excludes is not None:
        files = drop_excluded_by_repo(files, excludes)
    sources = source_files(files, languages, options)
    if fits_broadcast(languages):
        facts = materialize(file_facts(sources, options), "facts")
    else:
        # Texts are not shuffled to learn their repository's language; the small facts are.
        candidates = file_facts(candidate_files(files, options), options)
        facts = in_language(materialize(candidates, "candidate-facts"), languages)
        facts = materialize(facts, "facts")
    return scan_facts(facts, count_sources(languages, facts), options, further)
