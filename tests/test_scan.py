from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codestrata.operators import results
from codestrata.options import ScanOptions
from codestrata.plans import report
from codestrata.plans.scan import Scan, scan
from codestrata.scale import materialize
from codestrata.schema import REF_COLUMNS, VIOLATION_COLUMNS

BODY = "func copied() {\n" + "\tx := 1\n" * 7 + "}\n"
CORPUS = {
    ("shop", "api/a.go"): 'package a\nimport "x/db"\nimport "y/db"\n' + BODY + "panic(1)\n" * 6,
    ("shop", "lib/b.go"): BODY + "_ = a.b(1)\n// TODO\n" + "func unused() {\n}\n",
    ("shop", "vendor/c.go"): BODY,
    ("clean", "a.py"): "x = 1\n",
    ("docs", "README.md"): "TODO\n",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(repo, path, text) for (repo, path), text in CORPUS.items()]
    result = scan(spark.createDataFrame(rows, "repo string, path string, text string"))
    return Scan(
        materialize(result.repos, "repos"),
        materialize(result.violations, "violations"),
        materialize(result.refs, "refs"),
    )


def test_scan(found):
    assert found.violations.columns == VIOLATION_COLUMNS
    assert found.refs.columns == REF_COLUMNS
    rows = {row.vkey: row for row in found.violations.filter("repo = 'shop'").collect()}
    assert found.violations.filter("repo <> 'shop'").count() == 0
    assert sorted((row.rule_id, row.severity) for row in rows.values()) == [
        ("bare-panic", "WARNING"),
        ("duplicate-block", "WARNING"),
        ("layer-boundary", "CRITICAL"),
        ("layer-boundary", "CRITICAL"),
        ("silent-error", "CRITICAL"),
        ("todo-fixme-critical", "INFO"),
    ]
    refs: dict[str, list[str]] = {}
    for row in found.refs.orderBy("ref_at", "ref_no").collect():
        refs.setdefault(row.vkey, []).append(row.ref)
    assert {key: len(value) for key, value in refs.items()} == {
        key: row.n_refs for key, row in rows.items()
    }
    assert refs["bare-panic:api/a.go"] == [f"api/a.go:{n}" for n in range(13, 19)]
    assert refs["boundary:api/a.go:0"] == ["api/a.go"]
    (copies,) = [value for key, value in refs.items() if key.startswith("duplicate:")]
    assert copies == ["api/a.go:4", "lib/b.go:1"]


def test_results(found):
    totals = results.summary(found.repos, found.violations)
    scores = {row.repo: (row.score, row.label) for row in results.health_score(totals).collect()}
    assert scores == {
        "shop": (100 - 3 * 15 - 2 * 5 - 1, "Degraded"),
        "clean": (100, "Excellent"),
        "docs": (100, "Excellent"),
    }
    assert {row.repo for row in results.gate(totals).filter("failed").collect()} == {"shop"}
    listed = {row.repo: row.suggestions for row in results.suggestions(totals).collect()}
    assert listed["shop"][0] == "1 copied functions to merge"
    assert [len(listed[repo]) for repo in ("shop", "clean", "docs")] == [3, 0, 0]
    stats = {row.repo: tuple(row)[1:] for row in results.stats(totals).collect()}
    assert stats["shop"] == (2, 6, 1, 2, 3)
    assert stats["docs"] == (0, 0, 0, 0, 0)
    worst = results.worst_offenders(found.refs).orderBy(F.col("n").desc()).collect()
    assert [(row.file, row.n) for row in worst] == [("api/a.go", 9), ("lib/b.go", 3)]
    ordered = [row.severity for row in results.by_severity(found.violations).collect()]
    assert ordered == ["CRITICAL"] * 3 + ["WARNING"] * 2 + ["INFO"]


def test_score_floor_and_labels(spark):
    rows = [("a", 3, 0), ("b", 7, 0), ("c", 0, 4), ("d", 0, 6)]
    totals = spark.createDataFrame(rows, "repo string, criticals long, warnings long")
    totals = totals.withColumn("infos", F.lit(0)).withColumn("total_files", F.lit(1))
    found = {row.repo: (row.score, row.label) for row in results.health_score(totals).collect()}
    assert found == {
        "a": (55, "Degraded"),
        "b": (0, "Critical Drift"),
        "c": (80, "Fair"),
        "d": (70, "Fair"),
    }


def test_toggles_and_thresholds(files):
    options = ScanOptions(
        duplicate_min_lines=10, god_function_lines=7, naming=False, boundaries=False, dead_code=True
    )
    rows_ = scan(files(CORPUS), options).violations.collect()
    assert {row.category for row in rows_} == {"AntiPattern", "DeadCode"}
    assert sum(row.rule_id == "god-function" for row in rows_) == 2
    assert [row.vkey for row in rows_ if row.category == "DeadCode"] == ["dead-code:lib/b.go:12"]


def test_one_file_is_no_ranking(spark):
    rows = [("r", "a", "a:1"), ("r", "a", "a:9"), ("s", "a", "a:1")]
    rows += [("s", "b", "b:2"), ("s", "a", "a:3")]
    refs = spark.createDataFrame(rows, "repo string, ref_path string, ref string")
    found = results.worst_offenders(refs).orderBy(F.col("n").desc()).collect()
    assert [(row.repo, row.file, row.n) for row in found] == [("s", "a", 2), ("s", "b", 1)]


def test_rules_are_distinct_by_title(found):
    again = found.violations.withColumn("path", F.concat(F.lit("z/"), "path"))
    rules = results.guardrail_rules(found.violations.unionByName(again))
    assert rules.count() == 5
    first = rules.filter("title LIKE 'Panic%'").first()
    assert (first.path, first.reason[-1]) == ("api/a.go", ".")


def text_of(document, repo):
    rows = report.in_order(document).filter(F.col("repo") == repo).collect()
    return [row.text for row in rows]


def test_json_document(found):
    document = report.report_json(found)
    shop = json.loads("".join(text_of(document, "shop")))
    assert list(shop) == [
        "RepoPath",
        "Language",
        "TotalFiles",
        "Violations",
        "Suggestions",
        "Modules",
        "Stats",
    ]
    assert [row["Category"] for row in shop["Violations"]] == (
        ["Duplication"] + ["AntiPattern"] * 3 + ["BoundaryViolation"] * 2
    )
    assert shop["Violations"][0]["Files"] == ["api/a.go:4", "lib/b.go:1"]
    assert len(shop["Violations"][1]["Files"]) == 6
    assert shop["Stats"]["FilesScanned"] == 6
    clean = json.loads("".join(text_of(document, "clean")))
    assert clean["Violations"] is None and clean["Suggestions"] is None


# What there is to do about the findings of ``shop``, in detection order behind the copies.
REMEDIES = [
    "Return an error and let the caller decide.",
    "Check the returned error and log, wrap or return it.",
    "Move it to the issue tracker and delete the marker.",
    *["Declare an interface in the presentation layer and have the implementation passed in."] * 2,
]


def test_json_tells_the_remedy_of_each_rule(found):
    shop = json.loads("".join(text_of(report.report_json(found), "shop")))
    assert [row["Suggestion"] for row in shop["Violations"]][1:] == REMEDIES


def test_remedy_of_suggestions_that_are_not_the_common_text(found):
    violations = found.violations.filter("rule_id = 'silent-error'")
    other = violations.withColumn("suggestion", F.lit("Ask the owner."))
    assert other.select(results.remedy_of()).first()[0] == "Ask the owner."


def test_markdown_documents(found):
    shop = "\n".join(text_of(report.report_markdown(found), "shop"))
    assert shop.index("## 3 critical") < shop.index("## 2 warning") < shop.index("## 1 info")
    assert shop.index("* api/a.go:18") < shop.index("## Left to do")
    assert len(text_of(report.report_markdown(found), "clean")) == 1
    given = found.repos.sparkSession.createDataFrame([("Go", "Run gofmt.")], "language string, text string")
    rules = "\n".join(text_of(report.rules_document(found, given), "shop"))
    assert rules.count("## ") == 5 and rules.startswith("# Rules for shop (Go)\n\nRun gofmt.")
    assert text_of(report.rules_document(found, given), "clean") == ["# Rules for clean (Python)"]
    notes = "\n".join(text_of(report.context_document(found, given), "shop"))
    assert notes.count("* Import from") == 2 and "Open marker" not in notes


def test_markdown_tells_categories_and_that_nothing_was_found(found):
    shop = text_of(report.report_markdown(found), "shop")
    listed = [text for text in shop if text.startswith("Category: ")]
    n_boundaries = listed.count("Category: BoundaryViolation")
    assert (len(listed), n_boundaries, "Nothing was found" in shop[0]) == (6, 2, False)
    title = next(n for n, text in enumerate(shop) if text.startswith("\n### "))
    assert shop[title + 1] in listed and shop[title + 3] == "Where:" and shop[title + 4][:2] == "* "
    assert text_of(report.report_markdown(found), "clean")[0].endswith("|\n\nNothing was found.")


def test_markdown_tells_the_remedy_of_each_rule(found):
    shop = text_of(report.report_markdown(found), "shop")
    listed = [text.removeprefix("To do: ") for text in shop if text.startswith("To do: ")]
    assert sorted(listed) == sorted([*REMEDIES, "Keep one copy in a shared place and call it."])


def test_notes_tell_remedies_conventions_and_a_checklist(found):
    given = found.repos.sparkSession.createDataFrame([("Go", "Run gofmt.")], "language string, text string")
    document = report.context_document(found, given)
    notes = text_of(document, "shop")
    assert sum(text.endswith(f": {REMEDIES[-1]}") for text in notes) == 2
    assert notes[1] == "\nRun gofmt." and notes[-1].startswith("\n## Before writing code\n\n1. ")
    clean = text_of(document, "clean")
    assert clean[1] == "\n" + report.DEFAULT_CONVENTIONS and clean[2:] == notes[-1:]


def test_nothing_to_look_for(files):
    off = dict.fromkeys(("duplication", "anti_patterns", "naming", "boundaries"), False)
    result = scan(files(CORPUS), ScanOptions(**off))
    assert result.violations.collect() == [] and result.refs.columns == REF_COLUMNS
    assert result.repos.count() == 3


def test_written_documents_and_tables(spark, found, tmp_path):
    report.write_documents(report.report_json(found), str(tmp_path / "json"))
    texts: dict[str, str] = {}
    for part in sorted((tmp_path / "json").glob("part-*.parquet")):
        for row in spark.read.parquet(str(part)).collect():
            texts[row.repo] = texts.get(row.repo, "") + row.text
    assert json.loads(texts["shop"])["TotalFiles"] == 2
    report.write_violations(found, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/violations")).count() == 6


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_repositories_are_independent_of_each_other_and_of_partitions(files, found):
    moved = {("other", path): text for (repo, path), text in CORPUS.items() if repo == "shop"}
    both = scan(files({**CORPUS, **moved}).repartition(7, "text"))
    for mine, theirs in ((both.violations, found.violations), (both.refs, found.refs)):
        alone = rows(theirs)
        assert rows(mine.filter("repo <> 'other'")) == alone
        copies = mine.filter("repo = 'other'").withColumn("repo", F.lit("shop"))
        assert rows(copies) == alone
