"""What filters do to each other, in every order they could be applied in.

The sets of filters that may have been applied are the states of a lattice, and applying one more
is an edge.  What an edge removes depends on the state it leaves and not on the order that led
there.  Paths are counted from both ends: orders that reach a state, forward, and orders that
leave one, backward; their product is the number of orders that use an edge.  A filter's Shapley
sum weighs what its edges remove by these counts, and the steps of a single order are read from the
same edges.

Documents are reduced to one count for each part and each set of filters they fail, so the lattice
works on ``2 ** filters`` numbers a part, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.text import let

BLANKS = " \t\n\x0b\f\r"
COPY = "E"

STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _few_words(least: int) -> Callable[[Column, Column], Column]:
    return lambda text, words: F.size(words) < least


def _few_distinct(percent: int) -> Callable[[Column, Column], Column]:
    return lambda text, words: 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def _many_capitals(percent: int) -> Callable[[Column, Column], Column]:
    def fails(text: Column, words: Column) -> Column:
        capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        return 100 * capitals > percent * F.length(text)

    return fails


def _holds(pattern: str) -> Callable[[Column, Column], Column]:
    return lambda text, words: text.rlike(pattern)


# Name of each filter and its failure, from a text and its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": _few_words(200),
    "B": _few_distinct(50),
    "C": _many_capitals(2),
    "D": _holds(r"[#$%&*|]"),
}


class Lattice:
    """States and edges of all sets of ``n`` filters, with the orders that pass through each."""

    def __init__(self, n: int) -> None:
        full = (1 << n) - 1
        self.reaching = np.zeros(full + 1, np.int64)
        self.leaving = np.zeros(full + 1, np.int64)
        self.reaching[0] = self.leaving[full] = 1
        edges = [(s, f) for s in range(full + 1) for f in range(n) if not s >> f & 1]
        for state, f in edges:  # a state's number is larger than those of its subsets
            self.reaching[state | 1 << f] += self.reaching[state]
        for state, f in reversed(edges):
            self.leaving[state] += self.leaving[state | 1 << f]
        self.state, self.filter = np.array(edges, np.int64).reshape(-1, 2).T
        self.after = self.state | 1 << self.filter
        # Orders that use each edge.
        self.orders = self.reaching[self.state] * self.leaving[self.after]

        masks = np.arange(full + 1)
        fails = (masks >> self.filter[:, None] & 1).astype(np.int64)
        passed = (masks & self.state[:, None] == 0).astype(np.int64)
        # Which sets of failures an edge removes, finds removed already, leaves, and fails alone.
        self.removes, self.finds_gone = fails * passed, fails * (1 - passed)
        self.keeps = (masks & self.after[:, None] == 0).astype(np.int64)
        self.alone = (masks == (1 << self.filter)[:, None]).astype(np.int64)
        self.of_filter = (self.filter == np.arange(n)[:, None]).astype(np.int64)

        self.orderings = list(permutations(range(n)))
        number = {edge: k for k, edge in enumerate(edges)}
        self.path = np.array(
            [
                [number[sum(1 << g for g in order[:k]), f] for k, f in enumerate(order)]
                for order in self.orderings
            ],
            np.int64,
        ).reshape(len(self.orderings), n)

    def measures(self, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[np.ndarray]:
        """By edge, from the counts of one part by set of failures, in the order of the result."""
        removed = self.removes @ n
        shapley = self.of_filter @ (self.orders * removed)
        return [
            self.keeps @ n,
            removed,
            self.finds_gone @ n,
            self.alone @ n,
            self.removes @ good,
            self.removes @ toxic,
            shapley[self.filter],
        ]


def _failures(
    text: Column, filters: Mapping[str, Callable[[Column, Column], Column]]
) -> Column:
    """Set of failed filters as a number, the first filter being bit 0."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    none = F.array().cast("array<string>")
    words = F.when(trimmed == "", none).otherwise(F.split(trimmed, r"[ \t-\r]+"))

    def mask(words: Column) -> Column:
        bits = [fails(text, words).cast("int") * (1 << k) for k, fails in enumerate(filters.values())]
        return sum(bits, F.lit(0))

    return let(words, mask)


def failure_counts(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Callable[[Column, Column], Column]],
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part by the set of filters they fail.

    The last bit is that of copies: documents whose text a smaller id has.  The least id of a
    text is found by a hash of the text, with each task's least first; it is joined on text and id
    together, so a text that many documents share goes to as many tasks as the documents.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    rows = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        F.coalesce(docs[part_column].cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(text)).alias("copy"),
        _failures(text, filters).alias("mask"),
    )
    least = rows.groupBy(F.col("copy").alias("text")).agg(F.min("doc_id").alias("least"))
    same = (F.col("copy") == F.col("text")) & (F.col("doc_id") == F.col("least"))
    rows = rows.join(least, same, "left")
    is_copy = (F.col("doc_id").isNotNull() & F.col("least").isNull()).cast("int")

    marked = labels.filter("quality = 1 OR toxic = 1").groupBy(
        F.col("doc_id").cast("long").alias("labelled")
    )
    marked = marked.agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"),
    )
    rows = rows.select(
        "doc_id", "part", (F.col("mask") + is_copy * (1 << len(filters))).alias("mask")
    )
    rows = rows.join(marked, F.col("doc_id") == F.col("labelled"), "left")
    return rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS,
    copy_name: str = COPY,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    A filter is a name of one letter and a failure, as a Column of the text and its words;
    ``copy_name`` names one more, which a document fails if a smaller id has the same text
    anywhere in the table.  ``kept``, ``removed``, ``redundant`` (fails, but removed before),
    ``unique_fails`` (fails this one only), ``good_lost`` and ``toxic_lost`` (removed here, and
    labelled so) count documents of the part; ``shapley`` is what the filter removes, summed over
    all orders.

    A null text is empty; a null part is the empty string; a null id has no label, is no copy and
    makes none; rows that share an id and a text are no copies of each other; of several labels of
    one id any that says so counts; other columns are left out; an empty table gives no rows.  A
    very long text's words are one array in its task.
    """
    counts = failure_counts(docs, labels, filters, id_column, text_column, part_column)
    # A part has a row for each set of failures, 2 ** filters at most.
    parts = counts.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts")
    )
    letters = [*filters, copy_name]

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(len(letters))
        names = ["".join(letters[f] for f in order) for order in lattice.orderings]
        orders = pa.array(np.repeat(names, len(letters)).tolist(), pa.string())
        step = pa.array(np.tile(np.arange(1, len(letters) + 1), len(names)), pa.int32())
        edges = lattice.path.ravel()
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = np.zeros((3, len(lattice.reaching)), np.int64)
                for row in found:
                    n[row["mask"]] = row["n"]
                    good[row["mask"]], toxic[row["mask"]] = row["good"], row["toxic"]
                measured = [pa.array(m[edges]) for m in lattice.measures(n, good, toxic)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(edges), pa.string()), orders, step, *measured],
                    [field.split()[0] for field in STEPS.split(", ")],
                )

    return parts.select("part", "counts").mapInArrow(steps, STEPS)
