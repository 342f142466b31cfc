"""The queries: each operator over the given tables or over the code corpus derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.functions.paths import layer_of, layer_of_path
from codestrata.operators import deadcode, duplicates, naming, results
from codestrata.operators.boundaries import (
    crossing_imports,
    given_layers,
    given_pairs,
    imports_of,
    with_imports,
)
from codestrata.operators.languages import (
    detect_language,
    drop_excluded,
    drop_excluded_by_repo,
    drop_skipped,
    source_files,
)
from codestrata.operators.patterns import (
    PATTERN_RULES,
    RULES,
    capped_refs,
    hits_of,
    given_rules,
    rules_for,
    rules_table,
    with_hits,
)
from codestrata.operators.segment import (
    blocks_of,
    god_functions_of,
    with_blocks,
    with_god_function,
)
from codestrata.plans import report
from codestrata.plans.facts import file_facts
from codestrata.plans.scan import Scan, count_sources, scan_facts
from codestrata.plans.scan import scan as full_scan
from codestrata.options import ScanOptions
from codestrata.scale import materialize, unnest, workspace
from codestrata.sources.changes import read_changes
from codestrata.sources.corpus import corpus_from_table, read_corpus
from codestrata.streaming import watch
from workload.derived import corpus, table

# Exclude patterns of the exclude query, one of each form.
EXCLUDES = ("**/migrations/**", "**/f*7_0.*", "gen/", "f?_[0-9].py")

# Pause that ends a burst in the events table.
EVENT_PAUSE_MS = 20 * 60 * 1000

Query = Callable[[SparkSession, str], DataFrame]

_stored: dict[tuple[str, str, str], DataFrame] = {}


def _once(name: str, build: Query) -> Query:
    """Store what ``build`` gives, once per session and scale, for the queries that share it."""

    def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, name)
        if key not in _stored:
            _stored[key] = materialize(build(spark, sf_dir), name)
        return _stored[key]

    return stored


languages = _once("languages", lambda spark, sf: detect_language(corpus(spark, sf)))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(corpus(spark, sf_dir), languages(spark, sf_dir))


facts = _once("facts", lambda spark, sf: file_facts(sources(spark, sf)))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_sources(languages(spark, sf_dir), facts(spark, sf_dir))


_scans: dict[tuple[str, str], Scan] = {}


def scanned(spark: SparkSession, sf_dir: str) -> Scan:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _scans:
        found = scan_facts(facts(spark, sf_dir), repos(spark, sf_dir))
        _scans[key] = Scan(
            materialize(found.repos, "repos"),
            materialize(found.violations, "violations"),
            materialize(found.refs, "references"),
        )
    return _scans[key]


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = scanned(spark, sf_dir)
    return results.summary(scan.repos, scan.violations)


# Documents as a corpus -------------------------------------------------------------------------


def documents(spark: SparkSession, sf_dir: str, repo: str = "source") -> DataFrame:
    return corpus_from_table(
        table(spark, sf_dir, "documents"), F.col(repo), F.col("doc_id"), F.col("text")
    )


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = [r for r in PATTERN_RULES if r.rule_id == "hardcoded-secret"]
    return hits_of(with_hits(documents(spark, sf_dir), rule, any_language=True))


def secret_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret, with its line."""
    return _secrets(spark, sf_dir).select(
        "repo", "path", F.posexplode("lines").alias("ord", "line")
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each source of documents by the secrets written into it."""
    docs = documents(spark, sf_dir)
    hits = _secrets(spark, sf_dir).select(
        "repo", F.lit("CRITICAL").alias("severity"), F.lit("AntiPattern").alias("category")
    )
    totals = docs.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"))
    counted = results.summary(totals, hits)
    return counted.select("repo", "total_files", "criticals", results.score_of().alias("score"))


def text_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in the first 4096 bytes, apart from one that was cut in half."""
    cut = r"\x{FFFD}+$"
    prefix = F.regexp_replace(T.text_prefix(F.col("text"), 4096), cut, "")
    return documents(spark, sf_dir).select(
        "path", F.length(prefix).alias("n_chars"), F.sha2(prefix, 256).alias("hash")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    generator = F.posexplode_outer(T.lines(F.col("text"))).alias("pos", "line")
    listed = unnest(documents(spark, sf_dir), ["path"], generator, "pos")
    return listed.select("path", (F.col("pos") + 1).alias("line_no"), "line")


def normalize_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(
        "path", "line_no", T.normalize_line(F.col("line")).alias("normalized")
    )


def block_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("path", T.block_hash(F.col("text")).alias("hash"))


def _normal(text: Column) -> Column:
    return T.normalize_text(T.scanned_text(text))


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "path", T.preview(F.split(_normal(F.col("text")), "\n", -1)).alias("preview")
    )


def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "path", T.first_sentence(F.col("text")).alias("sentence")
    )


def _document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with one block: its whole normalised text."""
    block = F.struct(
        F.lit(1).alias("line"),
        T.block_hash(_normal(F.col("text"))).alias("hash"),
        F.lit("").alias("preview"),
    )
    return materialize(
        documents(spark, sf_dir).select("repo", "path", F.array(block).alias("blocks")),
        "document-blocks",
    )


def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source whose normalised texts are equal."""
    _, places = duplicates.duplicate_blocks(_document_blocks(spark, sf_dir))
    return places.select("repo", "hash", "path", "n")


def duplicate_documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same across all sources."""
    _, places = duplicates.duplicate_blocks(_document_blocks(spark, sf_dir), across_repos=True)
    return places.select("repo", "hash", "path", "n")


def identifier_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir, "lang").withColumn("lang", F.lit(""))
    return deadcode.identifier_frequency(deadcode.with_names(files))


def _page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files and their links as imports."""
    return table(spark, sf_dir, "pages").select(
        F.lit("web").alias("repo"),
        F.col("url").alias("path"),
        F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("imports"),
    )


def page_link_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crossing_imports(_page_links(spark, sf_dir))
    return found.select("path", "ord", "target", "from_layer", "to_layer")


# Layers of a site of one's own, by priority, and links that they may not have.
SITE_LAYERS = [(2, "deep", "[0-9]{2}"), (1, "top", "www|//"), (3, "rest", "[a-z]")]
SITE_PAIRS = [("rest", "top"), ("deep", "top"), ("deep", "rest"), ("rest", "deep")]


def custom_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with tables of layers and of forbidden pairs."""
    layers = spark.createDataFrame(SITE_LAYERS, "prio int, layer string, pattern string")
    pairs = spark.createDataFrame(SITE_PAIRS, "from_layer string, to_layer string")
    links = _page_links(spark, sf_dir)
    found = crossing_imports(links, layers=given_layers(layers), forbidden=pairs)
    return found.select("path", "ord", "target", "from_layer", "to_layer")


# The derived code corpus -----------------------------------------------------------------------


def write_tree(files: DataFrame, folder: str, ending: str = "") -> None:
    """Write a corpus as a tree of files, one folder per repository.

    An ``ending`` of a compressed format is put behind every name, and the file compressed so.
    """
    schema = "n long"

    def write(batches):
        import os

        import pandas as pd
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        for batch in batches:
            for repo, path, text in zip(batch["repo"], batch["path"], batch["text"], strict=True):
                target = f"{base}/{repo}/{path}{ending}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(target) as stream:
                    stream.write(text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    files.select("repo", "path", "text").mapInPandas(write, schema).agg(F.sum("n")).collect()


# Texts of code take a small part of their size, and every file of a tree is compressed by itself.
TREE_ENDING = ".zst"


def read_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, written as a tree of files and read from it; directories a scan skips are not."""
    folder = f"{workspace(spark)}/tree-{uuid.uuid4().hex}"
    write_tree(corpus(spark, sf_dir), folder, TREE_ENDING)
    files = read_corpus(spark, folder)
    path = F.expr(f"left(path, length(path) - {len(TREE_ENDING)})")
    return files.select("repo", path.alias("path"), F.sha2("text", 256).alias("hash"))


def skip_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_skipped(corpus(spark, sf_dir)).select("repo", "path")


def exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_excluded(corpus(spark, sf_dir), EXCLUDES).select("repo", "path")


def excludes_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the patterns for repositories that end in an even digit, the others for the rest."""
    even = F.substring("repo", -1, 1).isin(*"02468")
    first, second = (F.array(*map(F.lit, some)) for some in (EXCLUDES[:2], EXCLUDES[2:]))
    repos = corpus(spark, sf_dir).select("repo").distinct()
    return repos.select("repo", F.explode(F.when(even, first).otherwise(second)).alias("pattern"))


def exclude_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the patterns of their own repository leave."""
    patterns = excludes_by_repo(spark, sf_dir)
    return drop_excluded_by_repo(corpus(spark, sf_dir), patterns).select("repo", "path")


def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_language(corpus(spark, sf_dir))


def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("repo", "path", "lang")


def line_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: lines that open a function, and the white space lines begin with."""
    counts = T.let(
        T.lines(F.col("text")),
        lambda lines: F.struct(
            F.size(F.filter(lines, lambda line: T.is_func_start(line))).cast("long").alias("openings"),
            F.aggregate(
                lines,
                F.lit(0).cast("long"),
                lambda blanks, line: blanks + T.leading_whitespace(line),
            ).alias("blanks"),
        ),
    )
    files = sources(spark, sf_dir).select("repo", "path", counts.alias("found"))
    return files.select("repo", "path", "found.openings", "found.blanks")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = with_blocks(sources(spark, sf_dir))
    return unnest(cut, ["repo", "path", "lang"], F.inline_outer("blocks"), "line")


def segment_brace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).filter("lang <> 'Python'").drop("lang")


def segment_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).filter("lang = 'Python'").drop("lang")


def god_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return god_functions_of(with_god_function(sources(spark, sf_dir)))


def pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule, and line of each hit."""
    found = hits_of(with_hits(sources(spark, sf_dir)))
    rule_id = F.get(F.array(*[F.lit(rule.rule_id) for rule in RULES]), F.col("rule_no"))
    return found.select(
        "repo", "path", rule_id.alias("rule_id"), F.posexplode("lines").alias("ord", "line")
    )


def capped_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits_of(facts(spark, sf_dir))
    refs = capped_refs(F.col("path"), F.col("lines"))
    return found.select("repo", "path", "rule_no", F.array_join(refs, " ").alias("refs"))


def rule_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = rules_for(languages(spark, sf_dir), rules_table(spark))
    return applied.select("repo", "language", "rule_id", "severity")


# Rules for documents of one's own.
DOCUMENT_RULES = [
    ("address", "WARNING", None, "[A-Za-z0-9.]+@[A-Za-z0-9]+", "Mail address", None, None),
    ("licence", "INFO", None, "(?i)licen[cs]e", "Words of a licence", None, None),
    ("number", "CRITICAL", None, "[0-9]{3}[-. ][0-9]{4}", None, None, "Remove the number."),
]
RULE_COLUMNS = (
    "rule_id string, severity string, languages array<string>, pattern string, title string,"
    " description string, suggestion string"
)


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a table of rules in all documents, by line."""
    rules = given_rules(spark.createDataFrame(DOCUMENT_RULES, RULE_COLUMNS))
    hits = hits_of(with_hits(documents(spark, sf_dir), rules, any_language=True))
    rule = F.get(F.array(*[F.lit(r.rule_id) for r in rules]), F.col("rule_no") - len(RULES))
    severity = F.get(F.array(*[F.lit(r.severity) for r in rules]), F.col("rule_no") - len(RULES))
    lines = hits.select(
        "path", rule.alias("rule_id"), severity.alias("severity"), F.explode("lines").alias("line")
    )
    return lines.groupBy("path", "rule_id", "severity", "line").agg(F.count(F.lit(1)).alias("n_hits"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = duplicates.duplicate_groups(blocks_of(facts(spark, sf_dir), ["hash", "preview"]))
    return groups.withColumn("severity", duplicates.severity_of_copies(F.col("n")))


def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, places = duplicates.duplicate_blocks(facts(spark, sf_dir))
    return places


def duplicate_blocks_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, places = duplicates.duplicate_blocks(facts(spark, sf_dir), across_repos=True)
    return places


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imports_of(with_imports(sources(spark, sf_dir)))


def path_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(
        "repo", "path", layer_of_path(F.col("path")).alias("layer")
    )


def import_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imports_of(facts(spark, sf_dir))
    return found.withColumn("layer", layer_of(F.col("target")))


def boundary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossing_imports(facts(spark, sf_dir))


_names = _once(
    "names",
    lambda spark, sf: deadcode.with_names(sources(spark, sf)).select(
        "repo", "path", "lang", "definitions", "names"
    ),
)


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.definitions_of(_names(spark, sf_dir))


def code_identifier_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.identifier_frequency(_names(spark, sf_dir))


def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadcode.dead_code(_names(spark, sf_dir))


def naming_go(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.naming_go(facts(spark, sf_dir))


def naming_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.naming_python(facts(spark, sf_dir))


def python_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.python_names(facts(spark, sf_dir))


# Scan results ----------------------------------------------------------------------------------

_LISTED = ["repo", "vkey", "rule_id", "severity", "category", "path", "line", "title", "n_refs"]


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_facts(facts(spark, sf_dir), repos(spark, sf_dir)).violations.select(*_LISTED)


def scan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_facts(facts(spark, sf_dir), repos(spark, sf_dir))
    return found.refs.select("repo", "vkey", "severity", "ref_path", "ref")


def scan_with_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the files themselves, with every violation."""
    found = full_scan(corpus(spark, sf_dir), ScanOptions(dead_code=True))
    return found.violations.select("repo", "vkey", "category", "severity", "path", "line")


# A marker that no ASCII letter, digit or underscore is next to.
MARKER = "(?<![A-Za-z0-9_])(?i:TODO|FIXME|HACK|XXX)(?![A-Za-z0-9_])"
# A rule for Go, and the one pair of layers that is forbidden.
GO_RULES = [
    ("go-marker", "CRITICAL", ["Go"], MARKER, "Marker in Go", None, None)
]
ONE_PAIR = [("presentation", "infrastructure")]


def scan_with_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan with other limits, a rule and a forbidden pair from tables, and each repository's patterns."""
    options = ScanOptions(
        god_function_lines=60,
        duplicate_min_lines=12,
        rules=given_rules(spark.createDataFrame(GO_RULES, RULE_COLUMNS)),
        forbidden=given_pairs(spark.createDataFrame(ONE_PAIR, "from_layer string, to_layer string")),
    )
    found = full_scan(corpus(spark, sf_dir), options, excludes_by_repo(spark, sf_dir))
    return found.violations.select(*_LISTED)


def scan_without_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a scan that looks for nothing."""
    off = dict.fromkeys(("duplication", "anti_patterns", "naming", "boundaries"), False)
    found = scan_facts(facts(spark, sf_dir), repos(spark, sf_dir), ScanOptions(**off))
    return results.stats(results.summary(found.repos, found.violations))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.stats(_summary(spark, sf_dir))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = results.suggestions(_summary(spark, sf_dir))
    return listed.select("repo", F.array_join("suggestions", "; ").alias("suggestions"))


def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.health_score(_summary(spark, sf_dir))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.gate(_summary(spark, sf_dir))


def by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = results.by_severity(scanned(spark, sf_dir).violations)
    rank = results.severity_rank(F.col("severity"))
    return ordered.select("repo", rank.alias("sev"), "detector", "vkey", "title")


def worst_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.worst_offenders(scanned(spark, sf_dir).refs)


def guardrail_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results.guardrail_rules(scanned(spark, sf_dir).violations)
    return found.select("repo", "category", "title", "reason", "required")


# A text for some languages, each after the language's own style guide.
CONVENTIONS = [
    ("Go", "gofmt decides on the layout."),
    ("Python", "PEP 8: lines have 79 characters at most."),
    ("Java", "One top-level class per source file."),
    ("TypeScript", "The compiler runs in strict mode."),
]


def _conventions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVENTIONS, "language string, text string")


def language_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.language_conventions(languages(spark, sf_dir), _conventions(spark))


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_markdown(scanned(spark, sf_dir))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_json(scanned(spark, sf_dir))


def guardrail_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rules_document(scanned(spark, sf_dir), _conventions(spark))


def context_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.context_document(scanned(spark, sf_dir), _conventions(spark))


# Change events ---------------------------------------------------------------------------------

CHANGE_PATH = (
    "concat(CASE event_id % 9 WHEN 0 THEN 'vendor/' WHEN 1 THEN 'out/' WHEN 2 THEN 'a/dist/' "
    "ELSE 'src/' END, 'f', CAST(user_id AS STRING), CASE event_id % 7 WHEN 0 THEN '.go' "
    "WHEN 1 THEN '.PY' WHEN 2 THEN '.txt' WHEN 3 THEN '.tsx' WHEN 4 THEN '.md' "
    "WHEN 5 THEN '.rs' ELSE '.jsx' END)"
)
CHANGE_OP = "CASE WHEN event_id % 4 = 0 THEN 'create' ELSE 'write' END"


def _as_changes(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("repo"),
        F.expr(CHANGE_PATH).alias("path"),
        F.expr(CHANGE_OP).alias("op"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )


def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _as_changes(table(spark, sf_dir, "events"))
    return watch.changed_sources(changes).select("repo", "path", "op", "event_id")


def _shown(bursts: DataFrame) -> DataFrame:
    def clock(name: str):
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)

    return bursts.select("repo", clock("first_ts"), clock("last_ts"), "n", "path")


def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = watch.changed_sources(_as_changes(table(spark, sf_dir, "events")))
    return _shown(watch.debounce(changes, EVENT_PAUSE_MS, order=("ts", "path")))


def debounce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream form, over the whole table."""
    schema = table(spark, sf_dir, "events").schema
    events = read_changes(spark, sf_dir, schema=schema, glob="events.parquet")
    folder = f"{workspace(spark)}/debounce-{uuid.uuid4().hex}"
    store = watch.BurstStore(spark, f"{folder}/store", EVENT_PAUSE_MS, 3_600_000)
    changes = watch.changed_sources(_as_changes(events))
    watch.debounce_stream(changes, store, f"{folder}/checkpoint", True).awaitTermination()
    return _shown(store.finish())


def _older(files: DataFrame) -> DataFrame:
    """An older state of the corpus: files not there yet, with other texts, and since removed."""
    kind = F.pmod(F.hash("repo", "path"), F.lit(4))
    known = files.filter(kind != 0)
    text = F.when(kind == 1, F.concat("text", F.lit("\npanic(1)\n// TODO\n"))).otherwise(F.col("text"))
    removed = files.filter(kind == 2).withColumn("path", F.concat(F.lit("old/"), "path"))
    return known.withColumn("text", text).unionByName(removed)


def rescan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan an older corpus, then follow the changes to the one there is now.

    The violations are those of a full scan; without the stream they are others.
    """
    files = corpus(spark, sf_dir)
    older = _older(files)
    folder = f"{workspace(spark)}/rescan-{uuid.uuid4().hex}"
    store = watch.ScanStore(spark, f"{folder}/store", buckets=8, merge_at=2)
    store.seed(older)
    now, before = (
        x.select("repo", "path", F.xxhash64("text").alias(name))
        for x, name in ((files, "now"), (older, "before"))
    )
    changed = now.join(before, ["repo", "path"], "full").filter("NOT (now <=> before)")
    changed = materialize(changed.select("repo", "path"), "changed-paths")
    # Several batches, in the order of the changes' time.
    second = F.pmod(F.hash("path"), F.lit(3))
    events = changed.select(
        "repo",
        "path",
        F.lit("write").alias("op"),
        F.timestamp_seconds(F.lit(1_700_000_000) + second).alias("ts"),
        second.alias("part"),
    )
    for part in range(3):
        rows = events.filter(F.col("part") == part).drop("part")
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/changes")

    def read_files(keys: DataFrame) -> DataFrame:
        return files.join(keys, ["repo", "path"], "left_semi")

    changes = read_changes(spark, f"{folder}/changes", files_per_batch=1)
    query = watch.watch(changes, store, read_files, f"{folder}/checkpoint", available_now=True)
    query.awaitTermination()
    return store.results().violations.select(*_LISTED)


QUERIES: dict[str, Query] = {
    "line_shapes": line_shapes,
    "python_names": python_names,
    "scan_without_detectors": scan_without_detectors,
    "scan_with_options": scan_with_options,
    "custom_rules": custom_rules,
    "flagship": flagship,
    "read_corpus": read_tree,
    "skip_dirs": skip_dirs,
    "exclude": exclude,
    "exclude_by_repo": exclude_by_repo,
    "detect_language": detect,
    "source_files": source_paths,
    "text_prefix": text_prefix,
    "lines": lines,
    "normalize_line": normalize_line,
    "block_hash": block_hash,
    "preview": preview,
    "first_sentence": first_sentence,
    "secret_hits": secret_hits,
    "pattern_hits": pattern_hits,
    "capped_locations": capped_locations,
    "rule_languages": rule_languages,
    "segment_brace": segment_brace,
    "segment_indent": segment_indent,
    "god_function": god_function,
    "duplicate_groups": duplicate_groups,
    "duplicate_blocks": duplicate_blocks,
    "duplicate_blocks_corpus": duplicate_blocks_corpus,
    "duplicate_documents": duplicate_documents,
    "duplicate_documents_corpus": duplicate_documents_corpus,
    "imports": imports,
    "path_layers": path_layers,
    "import_layers": import_layers,
    "boundary_violations": boundary_violations,
    "page_link_boundaries": page_link_boundaries,
    "custom_layers": custom_layers,
    "definitions": definitions,
    "identifier_frequency": identifier_frequency,
    "code_identifier_frequency": code_identifier_frequency,
    "dead_code": dead_code,
    "naming_go": naming_go,
    "naming_python": naming_python,
    "scan": scan,
    "scan_references": scan_references,
    "scan_with_dead_code": scan_with_dead_code,
    "stats": stats,
    "suggestions": suggestions,
    "health_score": health_score,
    "gate": gate,
    "by_severity": by_severity,
    "worst_offenders": worst_offenders,
    "guardrail_rules": guardrail_rules,
    "language_conventions": language_conventions,
    "report_json": report_json,
    "report_markdown": report_markdown,
    "guardrail_markdown": guardrail_markdown,
    "context_markdown": context_markdown,
    "changed_sources": changed_sources,
    "debounce": debounce,
    "debounce_stream": debounce_stream,
    "rescan_stream": rescan_stream,
}
