"""What the passes over a text look at, and the normal form of odd lines."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from codestrata.functions import text as T
from codestrata.operators import boundaries, naming, patterns, segment
from codestrata.operators.deadcode import name_counts
from codestrata.operators.patterns import PATTERN_RULES


def _normal(line: str) -> str:
    line = " ".join(part for part in line.replace("\xa0", " ").split(" ") if part)
    for mark in ("//", "#"):
        if not line.startswith(mark):
            line = line.split(mark)[0]
    return line.rstrip()


def test_odd_lines_are_normalised_alike(spark):
    dice = random.Random(5)
    lines = ["".join(dice.choices(" \t\r\x0b\xa0/#ab0", k=dice.randrange(14))) for _ in range(4000)]
    texts = ["\n".join(lines[n : n + 8]) for n in range(0, len(lines), 8)] + lines
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    found = frame.select("text", T.normalized_lines(F.col("text")).alias("lines")).collect()
    plain = str.maketrans("\t\r\x0b", "   ")
    for row in found:
        assert row.lines == [_normal(x) for x in row.text.translate(plain).split("\n")], row.text


def test_passes_look_at_few_lines(spark):
    go = 'import (\n\t"a"\n)\nfunc a() {\n' + "\tx := 1\n" * 5000 + "}\n"
    open_list = 'import (\n\t"a"\n' + "\tx\n" * 50
    python = "import os\n" + "x = 1\n" * 5000
    frame = spark.createDataFrame([(go, open_list, python)], "go string, open string, py string")
    listed = {
        "go": boundaries._lines_to_last(F.col("go"), "import ", list_end=boundaries._LIST_END),
        "open": boundaries._lines_to_last(F.col("open"), "import ", list_end=boundaries._LIST_END),
        "py": boundaries._lines_to_last(F.col("py"), "from", "import"),
        "none": boundaries._lines_to_last(F.col("py"), "require"),
    }
    told = T.let(
        F.split("go", "\n", -1),
        lambda lines: segment._telling_lines(
            lines, segment._has_brace, lambda line: F.startswith(line, F.lit("func"))
        ),
    )
    row = frame.select(*[F.size(x).alias(n) for n, x in listed.items()], told.alias("told")).first()
    assert (row.go, row.open, row.py, row.none) == (3, 53, 1, 0)
    assert row.told == [3, 4, 5004]


def test_few_names_of_a_file_are_ordered(spark):
    def file(name: str, lang: str = "Python"):
        styles = (None, None, [f"{name}C{n}" for n in range(9)], [f"{name}_s{n}" for n in range(9)])
        return ("r", name, lang, styles)

    schema = (
        "repo string, path string, lang string, naming struct<caps: boolean, camel: boolean,"
        " camel_functions: array<string>, snake_functions: array<string>>"
    )
    facts = spark.createDataFrame([file(name) for name in "bacde"], schema)
    assert naming.python_names(facts).count() == 90
    assert naming.python_names(facts, 3).count() == 30
    row = naming.naming_python(facts).first()
    assert (row.camel, row.snake) == (45, 45)
    assert (row.camel_examples, row.snake_examples) == ("aC0, aC1, aC2", "a_s0, a_s1, a_s2")


def test_function_words_are_searched_for_in_few_lines(spark):
    words = ["func", "def", "function", "public", "private", "protected", "static", "async"]
    lines = [f"\xa0 {word} x" for word in words] + [f"{word} " for word in words] + ["x = 1", "", "define x"]
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    opens = T.is_func_start(F.col("line"))
    assert [row[0] for row in frame.select(opens).collect()] == [True] * 8 + [False] * 11
    plan = frame.filter(opens)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains(line") < plan.index("RLIKE")


def _cut_by_hand(text: str, indented: bool) -> list[tuple[int, int]]:
    """Blocks of two lines and more as first line and number of lines, line by line."""
    lines, found, start, depth = text.removesuffix("\n").split("\n"), [], None, 0
    for n, line in enumerate(lines):
        bare = line.strip(" \t\r\x0b\xa0")
        if indented:
            indent = len(line) - len(line.lstrip(" \t"))
            if not bare or bare[0] in "#)]}@" or (start is not None and indent > depth):
                continue
            if start is not None:
                found.append((start + 1, n - start))
            start, depth = (n, indent) if bare.startswith("def ") else (None, 0)
        elif start is not None:
            depth += line.count("{") - line.count("}")
            if depth <= 0:
                found.append((start + 1, n - start + 1))
                start = None
        elif "{" in line and bare.startswith(("func ", "static ", "def ")):
            start, depth = n, line.count("{") - line.count("}")
    if indented and start is not None:
        found.append((start + 1, len(lines) - start))
    return [(line, n) for line, n in found if n >= 2]


def test_blocks_of_odd_texts_are_cut_in_arrow_batches(spark):
    dice = random.Random(7)
    parts = ["{", "}", "{ }", "func a() {", "\xa0static b", "def f(x):", "  def g():", "x = 1"]
    parts += ["é", " ", "\t", "\r", "\xa0", "#", "//", ")", "@"] + ["\n"] * 12
    texts = ["".join(dice.choices(parts, k=dice.randrange(90))) for _ in range(1500)]
    rows = [(text, lang) for text in texts for lang in ("Go", "Python")]
    frame = segment.with_blocks(spark.createDataFrame(rows, "text string, lang string"), 2)
    # No lambda of Spark's looks at lines or words: those cost most of a pass over the texts.
    shown = frame._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in shown and "lambda" not in shown
    for row in frame.collect():
        cut = [(block.line, block.line_count) for block in row.blocks]
        assert cut == _cut_by_hand(row.text, row.lang == "Python"), (row.text, row.lang)
        lines = [_normal(x) for x in row.text.replace("\t", " ").replace("\r", " ").split("\n")]
        for block in row.blocks:
            body = lines[block.line - 1 :][: block.line_count]
            shown = "\n    ".join([line for line in body if line][:4])
            assert block.preview == f"    {shown}\n    ..."
            assert block.hash == hashlib.sha256("\n".join(body).encode()).hexdigest()[:24]


def test_names_are_counted_in_arrow_batches(spark):
    frame = spark.createDataFrame([("b a_1 2c é1x b\nB",), ("",), (None,)], "text string")
    counted = frame.select(name_counts(F.col("text")).alias("names"))
    assert "ArrowEvalPython" in counted._jdf.queryExecution().executedPlan().toString()
    found = [row.names and [tuple(name) for name in row.names] for row in counted.collect()]
    assert found == [[("B", 1), ("a_1", 1), ("b", 2), ("c", 1), ("x", 1)], [], None]


def test_rules_fold_the_case_of_whole_words(spark):
    given = {
        "todo-fixme-critical": ["ToDo xTODO _todo fIXme", "haK", "haCK. XxX xxxx"],
        "hardcoded-secret": ['ſecRet="' + "ſ" * 10 + '"', "aPi_key: 'abcKdefghij'", 'passwd="short"'],
        "print-debug": ["fmt.Println fmt.Print fmt.Printf", "_print( print(", "xSystem.out.print System.out.print"],
    }
    counts = {"todo-fixme-critical": [2, 0, 2], "hardcoded-secret": [1, 1, 0], "print-debug": [2, 1, 1]}
    for rule in PATTERN_RULES:
        if rule.rule_id in given:
            # A search that begins with a look-around does it at every place of a text.
            assert not rule.pattern.startswith("(?")
            frame = spark.createDataFrame([(x,) for x in given[rule.rule_id]], "text string")
            lines = T.line_of_matches(F.col("text"), rule.pattern)
            assert [len(row[0]) for row in frame.select(lines).collect()] == counts[rule.rule_id]


def test_rules_find_in_bytes_what_they_find_in_texts(spark):
    dice = random.Random(11)
    words = ["_", "=", " ", "a.b(", "panic(", "except", " Exception", ":", "fmt.Print", "fmt.Println"]
    words += ["print(", "System.out.print", "api_key", "ApIkEy", "SECRET", "ſecret", "Password", "passwd"]
    words += ["Token", "toKen", "'", '"', "abcdefghij", "0123456ſKİı", "TODO", "todo", "Fİxme"]
    words += ["hack", "HACK", "xXx", "x", "é", "\x01", "\x02", " ", "\r", "\n", "\n", "\n", "="]
    texts = ["".join(dice.choices(words, k=dice.randrange(40))) for _ in range(3000)]
    texts += ["token='" + chr(n) * 10 + "' TOD" + chr(n) + "O " + chr(n) + "TODO" + chr(n) for n in range(1, 0x2200)]
    texts += ["", None, "token='abcdefghijsecret='abcdefghij'"]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    found = patterns.rule_hits(F.col("text"), None).alias("hits")
    # No rule's regex reads a text in Spark, nor does a lambda look at its lines.
    plan = frame.select(found)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
    lines = [T.line_of_matches(F.col("text"), rule.pattern).alias(f"r{n}") for n, rule in enumerate(PATTERN_RULES)]
    n_hits = 0
    for row in frame.select("text", found, *lines).collect():
        by_rule = {hit.rule_no: hit.lines for hit in row.hits}
        plain = {n: row[f"r{n}"] for n in range(len(PATTERN_RULES)) if row[f"r{n}"]}
        assert by_rule == plain, row.text
        n_hits += len(by_rule)
    assert n_hits > 3000


def _long_by_hand(text: str, lang: str, most: int) -> list[tuple[int, int, str]]:
    lines = text.removesuffix("\n").split("\n")
    opening = {
        "Go": r"[ \t\x0b\f\r\xa0]*func[\t\f\r ]+([A-Za-z0-9_]+)",
        "Python": r"[ \t\x0b\f\r\xa0]*def[\t\f\r ]+([A-Za-z0-9_]+)",
        "Java": r".*?(?<![A-Za-z0-9_])static(?![A-Za-z0-9_]).*[A-Za-z0-9_][\t\f\r ]+([A-Za-z0-9_]+)[\t\f\r ]*\(",
    }[lang]
    start, depth = None, 0
    for n, line in enumerate(lines):
        change = line.count("{") - line.count("}")
        if start is None:
            name = re.match(opening, line)
            if name:
                start, depth = n, change
            continue
        depth += change
        margin = line[:1] not in ("", " ", "\t") and line.strip(" \t\r\x0b\f\xa0")
        # A line without braces changes nothing, but for the one behind an opening.
        telling = change or "{" in line or n == start + 1 or re.match(opening, line)
        ends = n > start + 1 and margin if lang == "Python" else telling and depth <= 0
        if ends:
            if n - start > most:
                return [(start + 1, n - start, re.match(opening, lines[start])[1])]
            start = None
    return []


def test_long_functions_of_odd_texts_are_found_in_arrow_batches(spark):
    dice = random.Random(13)
    parts = ["{", "}", "{ }", "func a() {", "\xa0func\tb", "def f(x):", "  def g():", "x = 1", "static int c (x) {"]
    parts += ["é", " ", "\t", "\r", "\xa0", "\x0bz", "(", "func "] + ["\n"] * 12
    texts = ["".join(dice.choices(parts, k=dice.randrange(90))) for _ in range(2000)]
    rows = [(text, lang) for text in texts for lang in ("Go", "Python", "Java")] + [(None, "Go"), ("func a()\n\n\n", "Rust")]
    frame = segment.with_god_function(spark.createDataFrame(rows, "text string, lang string"), 2)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
    n_found = 0
    for row in frame.collect():
        by_hand = _long_by_hand(row.text, row.lang, 2) if row.text is not None and row.lang != "Rust" else []
        assert [tuple(found) for found in row.god] == by_hand, (row.text, row.lang)
        n_found += len(by_hand)
    assert n_found > 300


def test_lines_to_the_last_import_are_found_in_arrow_batches(spark):
    dice = random.Random(17)
    parts = ["import (", "import ", "from", "import", "a b", ")", "\xa0)", "é", "\t", " ", "　"] + ["\n"] * 6
    texts = ["".join(dice.choices(parts, k=dice.randrange(30))) for _ in range(2000)] + ["", None]
    frame = spark.createDataFrame([(text,) for text in texts], "text string")
    text = F.col("text")
    go = boundaries._lines_to_last(text, "import ", list_end=boundaries._LIST_END)
    found = frame.select("text", go.alias("go"), boundaries._lines_to_last(text, "from", "import").alias("py"))
    # Spark splits no whole text to find its last import.
    shown = boundaries.with_imports(frame.withColumn("lang", F.lit("Go")))
    for plan in (found, shown):
        assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()
    end = re.compile("\n[ \t\xa0　]*\\)[ \t\xa0　]*(?=\n|$(?!\n))")
    for row in found.collect():
        held = row.text or ""
        at = max(held.rfind("from") + 4 if "from" in held else 0, held.rfind("import") + 6 if "import" in held else 0)
        assert row.py == ((held[:at] + held[at:].split("\n")[0]).split("\n") if at else []), row.text
        at = held.rfind("import ") + 7 if "import " in held else 0
        match = end.search(held, at)
        assert row.go == (held[: match.end() if match else None].split("\n") if at else []), row.text
