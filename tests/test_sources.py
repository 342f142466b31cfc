from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.sources.corpus import corpus_from_table, list_tree, read_corpus


def write_tree(folder):
    for name, content in {
        "one/a.go": b"package a\n",
        "one/sub dir/b.go": "é".encode() + b"\xff",
        "one/node_modules/x.js": b"x",
        "two/pkg/__init__.py": b"",
        "two/.hidden/_c.py": b"c",
        "two/logo.png": b"\x00",
    }.items():
        target = folder / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    (folder / "two/again").symlink_to(folder, target_is_directory=True)
    (folder / "two/broken.py").symlink_to(folder / "nowhere")


EXPECTED = {
    ("one", "a.go"): "package a\n",
    ("one", "sub dir/b.go"): "é" + chr(0xFFFD),
    ("two", "pkg/__init__.py"): "",
    ("two", ".hidden/_c.py"): "c",
    ("two", "logo.png"): chr(0),
}


def test_read_corpus(spark, tmp_path):
    write_tree(tmp_path / "tree")
    root = str(tmp_path / "tree")
    found = {(row.repo, row.path): row.text for row in read_corpus(spark, root).collect()}
    assert found == EXPECTED
    assert list_tree(spark, f"file://{root}/").count() == len(EXPECTED)


def test_read_corpus_of_one_repository(spark, tmp_path):
    write_tree(tmp_path / "tree")
    root = str(tmp_path / "tree/two")
    single = read_corpus(spark, root, F.lit("r"), extensions=(".py",)).collect()
    assert {(row.repo, row.path, row.text) for row in single} == {
        ("r", "pkg/__init__.py", ""),
        ("r", ".hidden/_c.py", "c"),
        ("r", "logo.png", None),
    }


def test_corpus_from_table(spark):
    table = spark.createDataFrame([(1, "x", "text")], "id int, source string, body string")
    found = corpus_from_table(table, F.col("source"), F.col("id"), F.col("body")).first()
    assert tuple(found) == ("x", "1", "text")
