from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.operators.languages import (
    candidate_files,
    detect_language,
    drop_excluded,
    drop_skipped,
    source_files,
)
from codestrata.options import ScanOptions
from codestrata.scale import materialize


def kept(spark, patterns, names):
    frame = spark.createDataFrame([("r", name) for name in names], "repo string, path string")
    return {row.path for row in drop_excluded(frame, patterns).collect()}


@pytest.mark.parametrize(
    "pattern, names, expected",
    [
        (
            "**/migrations/**",
            ["migrations/a.go", "x/migrations/a.go", "migrations2/a.go"],
            {"migrations2/a.go"},
        ),
        ("gen*", ["gen/a.go", "a/gen1.go", "a/b.go"], {"a/b.go"}),
        (".*", ["a.go", "b/c.go"], set()),
        ("*", ["a.go"], set()),
        ("**/?", ["abc.go"], set()),
        ("**/*_test.go", ["a/b_test.go", "b.go", "a_test.go/c.go"], {"b.go"}),
        ("build2/", ["build2/a.go", "x/build2/a.go", "build2", "xbuild2/a.go"], {"xbuild2/a.go"}),
        ("a/b.go", ["a/b.go"], {"a/b.go"}),
        ("[a-", ["a", "[a-"], {"a", "[a-"}),
        ("[^a-c]x", ["ax", "dx"], {"ax"}),
        ("[b-a]", ["a", "b"], {"a", "b"}),
        ("a\\*b", ["a*b", "axb"], {"axb"}),
        ("f?.go", ["f1.go", "f12.go", "d/f2.go"], {"f12.go"}),
        ("f.go", ["fxgo", "f.go"], {"fxgo"}),
        ("./", ["a.go"], set()),
    ],
)
def test_exclude(spark, pattern, names, expected):
    assert kept(spark, (pattern,), names) == expected


def test_skip_dirs_tests_directories_and_the_repository_only(spark):
    rows = [("r", "vendor/a.go"), ("r", "a/bin/b.go"), ("r", "bin"), ("r", "vendors/a.go")]
    rows += [("x/build", "a.go")]
    frame = spark.createDataFrame(rows, "repo string, path string")
    left = {(row.repo, row.path) for row in drop_skipped(frame).collect()}
    assert left == {("r", "bin"), ("r", "vendors/a.go")}


def test_detect_language(spark):
    names = {
        "tsx": ["a.py", "b.py", "c.tsx", "d.tsx", "e.tsx"],
        "none": ["README.md", "Makefile"],
        "tie": ["a.go", "b.PY"],
        "skipped": ["vendor/a.go", "vendor/b.go", "x.rs"],
        "folders": ["lib.js/a.txt", "lib.js/b.txt", "web.js/c/d.txt", "z.py"],
    }
    rows = [(repo, path) for repo, paths_ in names.items() for path in paths_]
    frame = spark.createDataFrame(rows, "repo string, path string")
    found = {row.repo: (row.language, row.n_files) for row in detect_language(frame).collect()}
    assert found == {
        "tsx": ("Python", 5),
        "none": ("Unknown", 2),
        "tie": ("Go", 2),
        "skipped": ("Rust", 3),
        "folders": ("JavaScript", 4),
    }


def test_source_files_take_the_language_of_the_repository(files):
    corpus = files(
        {
            ("r", "a.ts"): "1",
            ("r", "b.TSX"): "2",
            ("r", "c.js"): "3",
            ("r", "gen/d.ts"): "4",
            ("r", "vendor/e.ts"): "5",
            ("u", "x.md"): "6",
        }
    )
    languages = materialize(detect_language(corpus), "languages")
    options = ScanOptions(exclude=("gen/",))
    found = {row.path for row in source_files(corpus, languages, options).collect()}
    assert found == {"a.ts", "b.TSX"}
    assert {row.lang for row in candidate_files(corpus).collect()} == {"TypeScript", "JavaScript"}


def test_walk_order(spark):
    frame = spark.createDataFrame([("a.go",), ("a-b/c.go",), ("a/x.go",)], "path string")
    ordered = frame.orderBy(paths.components(F.col("path"))).collect()
    assert [row.path for row in ordered] == ["a/x.go", "a-b/c.go", "a.go"]


def test_layers(spark):
    frame = spark.createDataFrame(
        [("guide/db.go",), ("x/db/service.go",), ("a/b.go",), ("SERVICE/a.go",)], "path string"
    )
    found = frame.select("path", paths.layer_of_path(F.col("path")).alias("layer")).collect()
    assert {row.path: row.layer for row in found} == {
        "guide/db.go": "presentation",
        "x/db/service.go": "infrastructure",
        "a/b.go": None,
        "SERVICE/a.go": "application",
    }
    rooted = frame.limit(1).select(paths.layer_of_path(F.lit("a/b.go"), "/srv/app").alias("x"))
    assert rooted.first().x == "application"


def test_relative_path(spark):
    frame = spark.createDataFrame([("/r/a.go",), ("/r",), ("/q/a.go",)], "path string")
    found = frame.select(paths.relative_path(F.col("path"), "/r").alias("x")).collect()
    assert [row.x for row in found] == ["a.go", "/r", "q/a.go"]
