"""Options that come as tables: layers, forbidden pairs, and patterns of single repositories."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codestrata.functions.paths import is_excluded
from codestrata.operators.boundaries import crossing_imports, given_layers, given_pairs
from codestrata.operators.languages import drop_excluded_by_repo
from codestrata.operators.patterns import given_rules
from codestrata.options import ScanOptions
from codestrata.plans.scan import detect_boundaries, scan

PATTERNS = ["**/gen/**", "gen/", "./", "**/*.py", "*_test.go", "a?[b-d].go", "[^/]*", ".*", "x/y", "[", "e.g/"]
PATHS = ["gen/a.go", "x/gen/a.go", "gen", "a.py", "x.py/b.go", "m_test.go", "axc.go", "axe.go", "exg/a.go", "e.g/a.go"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_mean_the_same_in_a_table(spark, pattern):
    files = spark.createDataFrame([("r", p) for p in PATHS] + [("s", p) for p in PATHS], "repo string, path string")
    given = spark.createDataFrame([("r", pattern), ("r", pattern), ("t", "*"), ("s", None)], "repo string, pattern string")
    left = drop_excluded_by_repo(files, given)
    kept = files.filter((F.col("repo") == "s") | ~is_excluded(F.col("path"), (pattern,)))
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, kept.collect()))


def test_scan_with_patterns_of_a_repository(spark, files):
    code = files({(repo, path): "panic(1)\n" for repo in "ab" for path in ("x.go", "old/y.go")})
    excludes = spark.createDataFrame([("a", "old/")], "repo string, pattern string")
    found = scan(code, excludes=excludes)
    assert sorted((v.repo, v.path) for v in found.violations.collect()) == [
        ("a", "x.go"), ("b", "old/y.go"), ("b", "x.go"),
    ]
    assert {r.repo: r.total_files for r in found.repos.collect()} == {"a": 1, "b": 2}


def test_layers_of_a_table(spark):
    layers = spark.createDataFrame(
        [(2, "low", "disk|net"), (1, "high", "page|net")], "prio int, layer string, pattern string"
    )
    rows = [("r", "page/a", ["the.disk", "net"]), ("r", "NET/a", ["disk"]), ("r", "other", ["disk"])]
    links = spark.createDataFrame(rows, "repo string, path string, imports array<string>")
    pairs = spark.createDataFrame([("high", "low")] * 2, "from_layer string, to_layer string")
    found = crossing_imports(links, layers=given_layers(layers), forbidden=pairs)
    assert sorted((r.path, r.target) for r in found.collect()) == [("NET/a", "disk"), ("page/a", "the.disk")]
    none = given_layers(layers.limit(0))
    assert crossing_imports(links, layers=none, forbidden=pairs).count() == 0


RULES = "rule_id string, severity string, languages array<string>, pattern string, title string, description string, suggestion string"
GOOD = ("shout", "WARNING", ["Go"], "[A-Z]{3}", "Capitals", None, "Whisper.")


def test_rules_of_a_table(spark, files):
    table = spark.createDataFrame([GOOD, ("any", "INFO", None, "a{2}", None, None, None)], RULES)
    code = files({("a", "x.go"): "ABC aa\n\nDEFG aaaa", ("b", "y.py"): "ABC aa"})
    found = scan(code, ScanOptions(rules=given_rules(table)))
    got = sorted((v.repo, v.rule_id, v.severity, v.title, v.suggestion, v.n_refs) for v in found.violations.collect())
    what = "Rework what any points at, or exclude the path."
    assert got == [
        ("a", "any", "INFO", "any", what, 3),
        ("a", "shout", "WARNING", "Capitals", "Whisper.", 2),
        ("b", "any", "INFO", "any", what, 1),
    ]
    assert sorted(r.ref for r in found.refs.filter("repo = 'a'").collect()) == ["x.go:1", "x.go:1", "x.go:3", "x.go:3", "x.go:3"]
    assert given_rules(table.limit(0)) == ()


@pytest.mark.parametrize(
    "change",
    [{0: None}, {0: "bare-panic"}, {1: "Loud"}, {3: None}, {3: "a*"}, {3: r"(a)\1"}, {3: r"(?<n>a)\k<n>"}],
)
def test_rules_that_cannot_be(spark, change):
    row = tuple(change.get(n, value) for n, value in enumerate(GOOD))
    with pytest.raises(ValueError):
        given_rules(spark.createDataFrame([row], RULES))


def test_no_two_rules_of_one_identifier_and_not_too_many(spark):
    with pytest.raises(ValueError):
        given_rules(spark.createDataFrame([GOOD, GOOD], RULES))
    with pytest.raises(ValueError):
        given_rules(spark.createDataFrame([(f"r{n}", *GOOD[1:]) for n in range(201)], RULES))


def test_layers_and_a_further_detector_in_a_scan(spark, files):
    code = files({("a", "page/x.go"): 'import "disk"\n', ("a", "disk/y.go"): 'import "page"\n'})
    pairs = spark.createDataFrame([("high", "low"), ("high", None)], "from_layer string, to_layer string")
    options = ScanOptions(layers=(("high", "page"), ("low", "disk")), forbidden=given_pairs(pairs))

    def each_file(facts, options):
        found, refs = detect_boundaries(facts.limit(0), options)
        more = facts.select(*[
            (F.col(f.name) if f.name in ("repo", "path") else F.lit("own" if f.dataType.typeName() == "string" else 1)).cast(f.dataType).alias(f.name)
            for f in found.schema
        ])
        return found.unionByName(more), refs

    found = scan(code, options, further=[each_file])
    got = sorted((v.rule_id, v.path) for v in found.violations.collect())
    assert got == [("layer-boundary", "page/x.go"), ("own", "disk/y.go"), ("own", "page/x.go")]
