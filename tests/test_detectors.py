from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from codestrata.operators import deadcode, naming
from codestrata.operators.boundaries import crossing_imports, imports_of, with_imports
from codestrata.operators.duplicates import duplicate_blocks, duplicate_groups
from codestrata.operators.patterns import capped_refs, hits_of, with_hits
from codestrata.operators.segment import (
    blocks_of,
    god_functions_of,
    with_blocks,
    with_god_function,
)


@pytest.fixture()
def code(spark):
    """Files of one language as ``(repo, path, lang, text)``."""

    def build(lang: str, *texts: str, repo: str = "r"):
        rows = [(repo, f"f{n}", lang, text) for n, text in enumerate(texts)]
        return spark.createDataFrame(rows, "repo string, path string, lang string, text string")

    return build


def blocks(frame, min_lines=1):
    found = blocks_of(with_blocks(frame, min_lines)).orderBy("path", "line").collect()
    return [(row.path, row.line, row.line_count) for row in found]


def test_brace_blocks(code):
    one_line = "func a() {}\n" + "x\n" * 8
    nested = "func a() {\n  func b() {\n  }\n}\nfunc c() {\n}"
    open_end = "func a() {\n" + "x\n" * 9
    no_brace = "func a()\n{\n}\n"
    late = "func a() {}\n{\n}\nx"
    frame = code("Go", one_line, nested, open_end, no_brace, late, "class A {\n}\n")
    assert blocks(frame) == [("f0", 1, 2), ("f1", 1, 4), ("f1", 5, 2), ("f4", 1, 3)]


def test_brace_blocks_keep_eight_lines(code):
    frame = code("Java", "  public x {\n\n\n\n\n\n}", "  public x {\n\n\n\n\n\n\n}")
    assert blocks(frame, 8) == [("f1", 1, 8)]
    assert blocks(code("Rust", "func x {\n\n\n\n\n\n\n}"), 8) == []


def test_indent_blocks(code):
    text = "\n".join(
        [
            "@one",
            "def a():",
            "    x",
            "@two",
            "def b():",
            "    def inner():",
            "        y",
            "",
            ")",
            "",
            "z = 1",
            "  def c():",
            "  # note",
            "    y",
            " stop",
            "def d():",
            "",
        ]
    )
    assert blocks(code("Python", text)) == [
        ("f0", 2, 3),
        ("f0", 5, 6),
        ("f0", 12, 3),
        ("f0", 16, 1),
    ]


def test_indent_blocks_need_a_name_after_def(code):
    assert blocks(code("Python", "def \nx", "async def a():\n  x", "def x\n  y")) == [("f2", 1, 2)]


def test_trailing_blank_lines_change_the_hash(code):
    body = "def a():\n" + "    x = 1\n" * 8
    frame = code("Python", body + "y = 2", body + "\ny = 2", body + "z = 2")
    found = {row.path: row.hash for row in blocks_of(with_blocks(frame)).collect()}
    assert found["f0"] == found["f2"] != found["f1"]


def test_duplicates(spark, code):
    body = "func a() {\n" + "  x()  // n\n" * 7 + "}\n"
    other = "func b() {\n" + "  x()\n" * 7 + "}\n"
    frame = code("Go", body + body + other, other, "y\n" + body.replace(" // n", ""))
    facts = with_blocks(frame, 8)
    cut = blocks_of(facts)
    groups, places = duplicate_blocks(facts)
    assert sorted((row.n, row.preview.split("\n")[0]) for row in groups.collect()) == [
        (2, "    func b() {"),
        (3, "    func a() {"),
    ]
    assert sorted((row.path, row.line, row.n) for row in places.collect()) == [
        ("f0", 1, 3),
        ("f0", 10, 3),
        ("f0", 19, 2),
        ("f1", 1, 2),
        ("f2", 2, 3),
    ]
    elsewhere = cut.unionByName(cut.withColumn("repo", F.lit("s")))
    spanning = duplicate_groups(elsewhere, across_repos=True)
    assert sorted(row.n for row in spanning.collect()) == [4, 6]


def gods(frame):
    found = god_functions_of(with_god_function(frame)).orderBy("path").collect()
    return [(row.path, row.line, row.length, row["name"]) for row in found]


def go_function(name: str, inner: int) -> str:
    return f"func {name}() {{\n" + "x\n" * inner + "}\n"


def test_god_function_go(code):
    method = "func (r *T) F() {\n" + "x\n" * 200 + "}\n"
    frame = code(
        "Go",
        go_function("a", 79),
        go_function("a", 80),
        method,
        go_function("a", 90) + go_function("b", 99),
        "func a() {\n" + "x\n" * 200,
        "func a()\n" + "x\n" * 90,
        go_function("a", 3) + "func b() {\n" + "x\n" * 85 + "}\n",
    )
    assert gods(frame) == [
        ("f1", 1, 81, "a"),
        ("f3", 1, 91, "a"),
        ("f6", 6, 86, "b"),
    ]


def test_the_line_that_closes_a_function_opens_none(code):
    swallowed = "func a() {}\n" + go_function("b", 90)
    closed = "func a()\nfunc b() }\n" + "x\n" * 90 + "}\n"
    assert gods(code("Go", swallowed, closed)) == [("f0", 1, 92, "a")]


def test_god_function_python(code):
    long = "def b():\n" + "  x\n" * 200
    frame = code(
        "Python",
        long,
        "def a():\n  x\n" + long + "x = 1",
        "x = 1\n" + long + "x = 1",
        "class A:\n  def m(self):\n" + "    x\n" * 90 + "y = 1\n",
    )
    assert gods(frame) == [("f2", 2, 201, "b"), ("f3", 2, 91, "m")]


def test_god_function_java_and_others(code):
    text = "class A {\n  public static int f(int x) {\n" + "    y();\n" * 90 + "  }\n}\n"
    assert gods(code("Java", text)) == [("f0", 2, 91, "f")]
    long = "function f() {\n" + "x\n" * 99 + "}\n"
    assert gods(code("TypeScript", long)) == []


def hits(frame):
    found = hits_of(with_hits(frame)).orderBy("path", "rule_no").collect()
    return [(row.path, row.rule_no, row.lines) for row in found]


def test_pattern_hits(code):
    go = [
        "_\n= a.b(\n",
        "x_ = a.b(",
        "// éTODO",
        "// xTODO and todo_",
        'token := "abcdefghij"',
        "Password = 'abcdefghi'",
        "Password =\n'abcdefghij'",
        "xpanic( panic( fmt.Println(",
        "ſecret: 'abcdefghij'",
    ]
    assert hits(code("Go", *go)) == [
        ("f0", 0, [1]),
        ("f2", 5, [1]),
        ("f6", 4, [1]),
        ("f7", 1, [1]),
        ("f7", 3, [1]),
        ("f8", 4, [1]),
    ]
    python = ["try\nexcept :\nexcept Exception:\nexcept ValueError:", "panic(", "xprint(\nprint("]
    assert hits(code("Python", *python)) == [("f0", 2, [2, 3]), ("f2", 3, [2])]
    assert hits(code("Rust", "panic( TODO")) == []


def test_locations_are_capped(code):
    frame = code("Go", *["panic(\n" * n for n in (4, 5, 6)])
    refs = hits_of(with_hits(frame)).select(capped_refs(F.col("path"), F.col("lines")).alias("x"))
    assert sorted(row.x for row in refs.collect()) == [
        [f"f0:{n}" for n in range(1, 5)],
        [f"f1:{n}" for n in range(1, 6)] + ["..."],
        [f"f2:{n}" for n in range(1, 6)] + ["..."],
    ]


def targets(frame):
    found = imports_of(with_imports(frame)).orderBy("path", "ord").collect()
    return [(row.path, row.target) for row in found]


def test_imports(code):
    go = [
        'import (\n\t"a/db" // note\n\n// "x"\n  y "c/d"\n)\nimport "e"',
        'import db "a/db"',
        'import "a" // b',
        'import (\n"a"\nimport (\n"b"\n)\n)\n"c"',
    ]
    assert targets(code("Go", *go)) == [
        ("f0", "note"),
        ("f0", "c/d"),
        ("f0", "e"),
        ("f2", 'a" // b'),
        ("f3", "a"),
        ("f3", "b"),
    ]
    python = ["import a, b as c", "  from x.y import z", "import a,", "from . import q"]
    assert targets(code("Python", *python)) == [
        ("f0", "a"),
        ("f0", "b as c"),
        ("f1", "x.y"),
        ("f2", "a"),
        ("f2", ""),
        ("f3", "."),
    ]
    java = ["import a.b;\nimport static c.d;\nimport e.*;", "import  f ;"]
    assert targets(code("Java", *java)) == [("f0", "a.b")]
    script = ["import x from 'a'\nconst b = require(\"b\"), c = require('c')", "x from 'd' from 'e'"]
    assert targets(code("JavaScript", *script)) == [("f0", "a"), ("f0", "b"), ("f1", "d")]
    assert targets(code("Rust", "import a;")) == []


def test_crossing_imports(spark):
    rows = [
        ("r", "handler/a.py", ["x.db", "y.db", "z", "service"]),
        ("r", "service/a.py", ["x.db", "model"]),
        ("r", "domain/a.py", ["x.db"]),
        ("r", "lib/a.py", ["x.db"]),
    ]
    frame = spark.createDataFrame(rows, "repo string, path string, imports array<string>")
    found = [(row.path, row.target) for row in crossing_imports(frame).collect()]
    assert sorted(found) == [
        ("handler/a.py", "x.db"),
        ("handler/a.py", "y.db"),
        ("service/a.py", "x.db"),
    ]


def test_definitions(code):
    go = "func a() {\n  func (t *T) b (\nfunc(c\nfunc (t) d() func e()"
    java = "public static List<X> f(\n  Foo(\n return g (x)\nprivate Foo(\nint[] h("
    frame = code("Go", go).unionByName(code("Java", java, repo="j"))
    found = deadcode.definitions_of(deadcode.with_names(frame))
    listed = sorted((row.repo, row.line, row["name"]) for row in found.collect())
    assert listed == [
        ("j", 1, "f"),
        ("j", 3, "g"),
        ("j", 4, "Foo"),
        ("j", 5, "h"),
        ("r", 1, "a"),
        ("r", 2, "b"),
        ("r", 4, "d"),
    ]


def test_dead_code(code):
    many = "".join(f"def dead{n:02d}(x):\n" for n in range(25))
    names = "def testX(\ndef main(\ndef used(\n# used\ndef TESTy(\ndef Example1(\ndef twice(\ndef twice(\n"
    frame = deadcode.with_names(code("Python", names + many))
    assert [row["name"] for row in deadcode.dead_code(frame).orderBy("line").collect()] == [
        f"dead{n:02d}" for n in range(25)
    ]
    assert deadcode.dead_code(deadcode.with_names(code("Python", names))).count() == 0
    apart = deadcode.with_names(code("Python", "def a():\n", "def b():\n a", "b = 1"))
    assert deadcode.dead_code(apart).count() == 0


def test_name_counts(code):
    frame = deadcode.with_names(code("Go", "b a1 b\n// a1 _x b 9z", "", "!"))
    listed = sorted((row.repo, row["name"], row.n) for row in deadcode.identifier_frequency(frame).collect())
    assert listed == [("r", "_x", 1), ("r", "a1", 2), ("r", "b", 3), ("r", "z", 1)]


def naming_rows(frame, lang):
    facts = naming.with_naming(frame)
    return (naming.naming_go if lang == "Go" else naming.naming_python)(facts).collect()


def test_naming_python(code):
    camel, snake = "def aB(\n", "def a_b(\n"
    assert naming_rows(code("Python", camel + snake * 3, *[""] * 3), "Python") == []
    assert naming_rows(code("Python", camel + snake * 2, *[""] * 4), "Python") == []
    row = naming_rows(code("Python", camel + snake * 3 + "def zz(", *[""] * 4), "Python")[0]
    assert (row.camel, row.snake) == (1, 4)
    assert (row.camel_examples, row.snake_examples) == ("aB", "a_b, a_b, a_b")
    late = code("Python", "#" * 100_000 + "\n" + camel, snake * 3, *[""] * 3)
    assert [row.camel for row in naming_rows(late, "Python")] == [1]
    listed = naming.python_names(naming.with_naming(late)).orderBy("path", "pos").collect()
    assert [(row.style, row["name"]) for row in listed] == [("camel", "aB")] + [("snake", "a_b")] * 3
    inner = code("Python", "  def aB(\n" + snake * 3, *[""] * 4)
    assert naming_rows(inner, "Python") == []


def test_naming_go(code):
    texts = ["const MAX_X = 1", "const MaxX = 1\nconst MinX = 1", "const MinX", "", ""]
    row = naming_rows(code("Go", *texts), "Go")[0]
    assert (row.caps_files, row.camel_files) == (1, 2)
    assert naming_rows(code("Go", *texts[:4]), "Go") == []
    assert naming_rows(code("Go", "const AB = 1", *texts[1:]), "Go") == []


@pytest.mark.parametrize("lang, function", [("Go", "func f%d() {\n%s}\n"), ("Python", "def f%d():\n%s")])
def test_time_of_cutting_grows_with_the_length(code, lang, function):
    """Blocks of one file: ten times as many take about ten times as long, not a hundred times."""

    def seconds(n):
        text = "".join(function % (k, "  x = 1\n" * 8) for k in range(n))
        frame = with_blocks(code(lang, text))
        took = []
        for _ in range(2):
            start = time.perf_counter()
            assert frame.select(F.size("blocks").alias("n")).first().n == n
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(20_000) < 25 * max(seconds(2_000), 0.2)


def test_time_of_finding_imports_grows_with_the_length(code):
    """Imports of one file: ten times as many take about ten times as long."""

    def seconds(n):
        frame = with_imports(code("Go", "import (\n" + "".join(f'\t"a/b{k}"\n' for k in range(n)) + ")\n"))
        took = []
        for _ in range(2):
            start = time.perf_counter()
            assert frame.select(F.size("imports").alias("n")).first().n == n
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(100_000) < 25 * max(seconds(10_000), 0.2)


@pytest.mark.parametrize("page", [1, 2, 7])
def test_pages_of_a_fold_change_nothing(code, page, monkeypatch):
    """Blocks, imports and long functions that begin on one page and end on another."""
    go = "".join(f"func f{k}() {{\n" + "  if x {\n  }\n" * (k % 6) + "}\n\n" for k in range(12))
    go += "func a() {}\nfunc b() {\n" + "x\n" * 9 + "}\n" + 'import (\n"p"\n\n// c\n"q"\n)\nimport "r"\n'
    python = "".join(f"@d\ndef f{k}():\n" + "    x\n" * k + "\n# c\n" for k in range(12)) + "z\n"

    def found():
        frame = code("Go", go, "", "func open() {\n" + "{\n" * 9)
        both = frame.unionByName(code("Python", python, "\n", python + "def last():\n  x\n" * 3, repo="p"))
        cut = blocks_of(with_blocks(both, 3)).drop("preview")
        long = god_functions_of(with_god_function(both, 5))
        return [sorted(map(tuple, x.collect())) for x in (cut, imports_of(with_imports(both)), long)]

    whole = found()
    assert len(whole[0]) > 20 and len(whole[1]) == 3 and whole[2]
    from codestrata.functions import text

    monkeypatch.setattr(text, "PAGE", page)
    assert found() == whole
