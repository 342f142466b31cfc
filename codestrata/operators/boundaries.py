"""Imports, the layers they join, and the pairs of layers that may not be joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.paths import Layers, layer_of, layer_of_path
from codestrata.functions.search import BLANKS, head_to_last
from codestrata.functions.text import (
    NON_SPACE,
    RE_BLANK,
    SPACE,
    found_in_order,
    trim_space,
)
from codestrata.scale import fits_broadcast, unnest
from codestrata.schema import FORBIDDEN_PAIRS, LAYERS

# Most rows that a table of layers, or of pairs that may not be joined, may have.
MOST_LAYERS = 1_000


def forbidden_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORBIDDEN_PAIRS, "from_layer string, to_layer string")


def _lines_to_last(text: Column, *words: str, list_end: bytes | None = None) -> Column:
    """Lines of ``text`` up to the one that holds the last of ``words``.

    With ``list_end``, a pattern of bytes, they go on to its first match behind that word, or to the
    end.  Spark would split a whole text to find its last word; tasks find it from the end.
    """
    head = head_to_last(text, tuple(word.encode() for word in words), list_end)
    none = F.array().cast("array<string>")
    return F.when(head.isNotNull(), F.split(head, "\n", -1)).otherwise(none)


# The line that closes an import list.  Behind it a pass over the imports is outside any list,
# where it meets no further import word.
_LIST_END = rb"\n" + BLANKS + rb"\)" + BLANKS + rb"(?=\n|\Z)"


def _go_imports(text_lines: Column) -> Column:
    """Inside ``import ( … )`` the last word of each line; outside, ``import "…"``."""

    def step(state: Column, raw: Column) -> Column:
        line = trim_space(raw)
        opens = line == "import ("
        closes = state.inside & (line == ")")
        single = ~state.inside & line.startswith('import "')
        listed = state.inside & ~opens & ~closes & (line != "") & ~line.startswith("//")
        word = F.btrim(
            F.regexp_extract(line, f"(?<!{NON_SPACE}){NON_SPACE}++$", 0), F.lit('"')
        )
        quoted = F.regexp_replace(F.substring(line, 9, 2**31 - 1), r'"\z', "")
        return F.struct(
            (opens | (state.inside & ~closes)).alias("inside"),
            F.when(single, quoted).when(listed & (word != ""), word).alias("found"),
        )

    def next_line(state: Column, raw: Column) -> Column:
        moved = F.struct(state.inside.alias("inside"), none.alias("found"))
        idle = ~state.inside & ~F.contains(raw, F.lit("import "))
        return F.when(idle, moved).otherwise(step(state, raw))

    none = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("inside"), none.alias("found"))
    return found_in_order(text_lines, start, next_line, "string")


def _python_imports(text_lines: Column) -> Column:
    trimmed = F.transform(
        F.filter(
            text_lines,
            lambda line: (F.contains(line, F.lit("from")) | F.contains(line, F.lit("import")))
            & line.rlike(f"^{SPACE}*(?:from|import){RE_BLANK}"),
        ),
        trim_space,
    )

    def targets(line: Column) -> Column:
        source = F.regexp_extract(line, rf"^from{RE_BLANK}+([A-Za-z0-9_.]+){RE_BLANK}+import", 1)
        listed = F.regexp_extract(line, rf"^import{RE_BLANK}+([A-Za-z0-9_.,\t\f\r ]+)", 1)
        return (
            F.when(source != "", F.array(source))
            .when(listed != "", F.transform(F.split(listed, ",", -1), trim_space))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.flatten(F.transform(trimmed, targets))


def _java_imports(text_lines: Column) -> Column:
    found = F.transform(
        F.filter(text_lines, lambda line: F.contains(line, F.lit("import"))),
        lambda line: F.regexp_extract(
            trim_space(line), rf"^import{RE_BLANK}+([A-Za-z0-9_.]+);", 1
        ),
    )
    return F.filter(found, lambda target: target != "")


def _script_imports(text_lines: Column) -> Column:
    def held(line: Column, word: str) -> Column:
        return F.contains(line, F.lit(word))

    found = F.transform(
        F.filter(text_lines, lambda line: held(line, "from") | held(line, "require")),
        lambda line: F.array(
            F.regexp_extract(line, rf"from{RE_BLANK}+['\"]([^'\"]+)['\"]", 1),
            F.regexp_extract(line, r"require\(['\"]([^'\"]+)['\"]\)", 1),
        ),
    )
    return F.filter(F.flatten(found), lambda target: target != "")


def import_targets(text: Column, lang: Column) -> Column:
    """Imports of a file in order, as an array; a text without an import word has none."""
    none = F.array().cast("array<string>")
    script = lang.isin("TypeScript", "JavaScript")

    # A text goes to the search for its own language's words only.
    def lines(known: Column, *words: str, list_end: bytes | None = None) -> Column:
        return _lines_to_last(F.when(known, text), *words, list_end=list_end)

    return (
        F.when(lang == "Go", _go_imports(lines(lang == "Go", "import ", list_end=_LIST_END)))
        .when(lang == "Python", _python_imports(lines(lang == "Python", "from", "import")))
        .when(lang == "Java", _java_imports(lines(lang == "Java", "import")))
        .when(script, _script_imports(lines(script, "from", "require")))
        .otherwise(none)
    )


def with_imports(files: DataFrame) -> DataFrame:
    """Add ``imports`` to ``(…, lang, text)``."""
    return files.withColumn("imports", import_targets(F.col("text"), F.col("lang")))


def imports_of(files_with_imports: DataFrame) -> DataFrame:
    """One row per import: ``(repo, path, ord, target)``."""
    generator = F.posexplode_outer("imports").alias("ord", "target")
    return unnest(files_with_imports, ["repo", "path"], generator, "ord")


def given_layers(layers: DataFrame) -> list[tuple[str, str]]:
    """Layers and patterns of a table ``(prio, layer, pattern)``, in order of priority.

    They become literals of an expression, so that a pattern is compiled once in a task and no row
    is shuffled to be classified; the table may have ``MOST_LAYERS`` rows.
    """
    if not fits_broadcast(layers, MOST_LAYERS):
        raise ValueError(f"a table of layers has {MOST_LAYERS} rows at most")
    rows = layers.orderBy("prio", "layer", "pattern").select("layer", "pattern").collect()
    return [tuple(row) for row in rows]


def given_pairs(pairs: DataFrame) -> list[tuple[str, str]]:
    """Forbidden pairs of a table ``(from_layer, to_layer)``, which has a bounded number of rows."""
    pairs = pairs.select("from_layer", "to_layer").distinct()
    if not fits_broadcast(pairs, MOST_LAYERS**2):
        raise ValueError(f"there are more than {MOST_LAYERS**2} pairs of layers")
    return sorted(tuple(row) for row in pairs.dropna().collect())


def crossing_imports(
    files_with_imports: DataFrame,
    root: str = "",
    layers: Layers = LAYERS,
    forbidden: DataFrame | None = None,
) -> DataFrame:
    """Imports whose pair of layers is forbidden, one row per import.

    ``layers`` are those of `given_layers` or the fixed ones, and ``forbidden`` is a table
    ``(from_layer, to_layer)``.  A path is classified once per file; files outside all layers drop
    out before their imports are looked at.
    """
    layer = layer_of_path(F.col("path"), root, layers)
    layered = files_with_imports.withColumn("from_layer", layer).filter("from_layer IS NOT NULL")
    generator = F.posexplode_outer("imports").alias("ord", "target")
    rows = unnest(layered, ["repo", "path", "from_layer"], generator, "ord")
    pairs = forbidden_table(rows.sparkSession) if forbidden is None else forbidden
    pairs = pairs.select("from_layer", "to_layer").distinct()
    if not fits_broadcast(pairs, MOST_LAYERS**2):
        raise ValueError(f"there are more than {MOST_LAYERS**2} pairs of layers")
    return rows.withColumn("to_layer", layer_of(F.col("target"), layers)).join(
        F.broadcast(pairs), ["from_layer", "to_layer"]
    )
