from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text as T


def apply(spark, function, values):
    frame = spark.createDataFrame(list(enumerate(values)), "n int, x string")
    found = frame.select("n", function(F.col("x")).alias("y")).orderBy("n")
    return [row.y for row in found.collect()]


def test_lines(spark):
    given = ["", "\n", "a", "a\n", "a\r\nb", "a\r\r\nb\r", "a\n\nb\n\n", "x\n\r"]
    assert apply(spark, T.lines, given) == [
        [],
        [""],
        ["a"],
        ["a"],
        ["a", "b"],
        ["a\r", "b"],
        ["a", "", "b", ""],
        ["x", ""],
    ]


def test_lines_of_any_length(spark):
    long = "y" * 2_000_000
    found = apply(spark, T.lines, [f"a\n{long}\r\nb", f"{long}\nb", "é" * 70_000])
    assert [len(lines) for lines in found] == [3, 2, 1]
    assert found[0] == ["a", long, "b"]


def test_a_fold_over_pages_finds_all_in_order(spark):
    """Running sums that end at every third item, and what is left."""

    def step(state, n):
        over = state.n == 2
        return F.struct(
            F.when(over, 0).otherwise(state.n + 1).alias("n"),
            F.when(over, 0).otherwise(state.total + n).alias("total"),
            F.when(over, state.total + n).alias("found"),
        )

    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("total"), F.lit(None).cast("int").alias("found")
    )
    listed = F.filter(F.sequence(F.lit(1), F.length("x") + 1), lambda n: n <= F.length("x"))
    found = apply(
        spark,
        lambda x: T.found_in_order(listed, start, step, "int", lambda state: F.array(state.total)),
        ["z" * n for n in (0, 1, 255, 256, 257, 1000)],
    )
    for n, sums in zip((0, 1, 255, 256, 257, 1000), found):
        assert sums[: n // 3] == [9 * k + 6 for k in range(n // 3)]
        assert sums[n // 3 :] == ([sum(range(n - n % 3 + 1, n + 1))] if n else [])


@pytest.mark.parametrize(
    "line, expected",
    [
        ('x = "http://h" # c', 'x = "http:'),
        ("// whole line", "// whole line"),
        ("# a # b", "# a # b"),
        ("// a // b # c", "// a // b"),
        ("  a \t b　 c  ", "a b c"),
        ("a//b//c", "a"),
        ("#a//b", "#a"),
        ("a # b // c", "a"),
        ("", ""),
        ("///x", "///x"),
        ("/ / //", "/ /"),
        ("   # c", "# c"),
    ],
)
def test_normalize_line(spark, line, expected):
    assert apply(spark, T.normalize_line, [line]) == [expected]


def test_normalize_text_keeps_the_lines_apart(spark):
    text = "  a  //x\n\n \n#  b\n c #d\n// e # f\n  "
    assert apply(spark, T.normalize_text, [text]) == ["a\n\n\n# b\nc\n// e\n"]


def test_first_sentence(spark):
    long = "é" * 100
    given = ["a.b c. d", ".a.b", "a\nb", "\nab", long, "x" * 121, "x" * 120]
    found = apply(spark, T.first_sentence, given)
    assert found[:4] == ["a.", ".a.b", "a", "\nab"]
    assert found[4:] == ["é" * 60 + "...", "x" * 120 + "...", "x" * 120]


def test_small_functions(spark):
    assert apply(spark, T.leading_whitespace, [" \t x", "x", chr(0xA0) + "y"]) == [3, 0, 0]
    digest = hashlib.sha256("é".encode()).hexdigest()[:24]
    assert apply(spark, T.block_hash, ["é"]) == [digest]
    found = apply(spark, lambda x: T.preview(F.split(x, "\n")), ["a\n\nb\nc\nd\ne"])
    assert found == ["    a\n    b\n    c\n    d\n    ..."]
    starts = ["func a", "  def x", "function", "export function a", "async x", "publicity"]
    assert apply(spark, T.is_func_start, starts) == [True, True, False, False, True, False]


def test_text_prefix_cuts_bytes(spark):
    assert apply(spark, lambda x: T.text_prefix(x, 3), ["abcd", "aéé", "aéb", "é"]) == [
        "abc",
        "aé",
        "aé",
        "é",
    ]
    assert apply(spark, lambda x: T.text_prefix(x, 2), ["aé"]) == ["a�"]


def test_lines_of_matches(spark):
    given = ["a\nx\nx x\n\nx", "none", "x" + chr(1) + "x\nx", "x\n" * 9]
    found = apply(spark, lambda c: T.line_of_matches(c, "x"), given)
    assert found == [[2, 3, 3, 5], [], [1, 1, 2], [1, 2, 3, 4, 5, 6, 7, 8, 9]]
    assert apply(spark, lambda c: T.line_of_matches(c, r"a\s*b"), ["a\n\nb a\nb"]) == [[1, 3]]
