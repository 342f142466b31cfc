"""Function blocks and over-long functions: one linear pass over the lines of each file.

Both are found in the tasks' Python, over Arrow batches: blocks as every line of them is looked at,
over-long functions as a lambda of Spark's would be called for every line of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.arrow import normal_blocks
from codestrata.functions.search import long_functions
from codestrata.functions.text import let
from codestrata.scale import unnest
from codestrata.schema import BRACE_LANGUAGES


def _has_brace(line: Column) -> Column:
    return F.contains(line, F.lit("{")) | F.contains(line, F.lit("}"))


def _telling_lines(
    lines: Column, tells: Callable[[Column], Column], opens: Callable[[Column], Column]
) -> Column:
    """Numbers of the lines that can change a state.

    Those are lines that tell something, which all do that open a block, and the line behind one
    that may open a block: it ends a block that its first line left without depth.
    """

    def with_next(told: Column) -> Column:
        opening = F.filter(told, lambda n: opens(F.get(lines, n)))
        behind = F.transform(opening, lambda n: n + 1)
        inside = F.filter(behind, lambda n: n < F.size(lines))
        return F.sort_array(F.array_union(told, inside))

    telling = F.transform(lines, lambda line, n: F.when(tells(line), n))
    return let(F.array_compact(telling), with_next)


_BLOCKS = "array<struct<line:int,line_count:int,hash:string,preview:string>>"


def function_blocks(text: Column, lang: Column, min_lines: int = 8) -> Column:
    """Blocks of a file as ``array<struct<line,line_count,hash,preview>>``."""
    # Every pass over Arrow batches takes the text as it is, so that tasks hand it on once.
    by_indent = F.when(lang == "Python", True).when(lang.isin(*BRACE_LANGUAGES), False)
    return normal_blocks(text, by_indent, min_lines, _BLOCKS)


def with_blocks(files: DataFrame, min_lines: int = 8) -> DataFrame:
    """Add ``blocks`` to ``(…, lang, text)``."""
    return files.withColumn("blocks", function_blocks(F.col("text"), F.col("lang"), min_lines))


def blocks_of(files_with_blocks: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per block: ``(repo, path, line, line_count, hash, preview)``.

    With ``fields`` only these are read from stored blocks.
    """
    if fields:
        zipped = F.arrays_zip(*[F.col(f"blocks.{name}").alias(name) for name in fields])
        return unnest(files_with_blocks, ["repo", "path"], F.inline_outer(zipped), fields[0])
    return unnest(files_with_blocks, ["repo", "path"], F.inline_outer("blocks"), "line")


def god_functions(text: Column, lang: Column, max_lines: int = 80) -> Column:
    """``array<struct<line,length,name>>`` with the first function over the limit, or empty."""
    return long_functions(text, lang, max_lines)


def with_god_function(files: DataFrame, max_lines: int = 80) -> DataFrame:
    """Add ``god``, an array of at most one function."""
    return files.withColumn("god", god_functions(F.col("text"), F.col("lang"), max_lines))


def god_functions_of(files_with_god: DataFrame) -> DataFrame:
    """``(repo, path, line, length, name)`` of the over-long functions."""
    return unnest(files_with_god, ["repo", "path"], F.inline_outer("god"), "line")
