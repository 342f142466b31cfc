"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The probability of a word is that of its class given the words before it, times those of its
sub-classes, each in the one above it, times that of the word in the last one.  Classes and
sub-classes are chosen by softmaxes with weights for the word before (n-gram of two), the one before
that (skip) and both (n-gram of three), hashed into a table of classes and one of sub-classes, on top
of the smoothed counts of what is below them.  Every task runs minibatch updates over all of its
training texts; tables are averaged row by row, each task counted by how often it met the row.
Classes come from all training texts: frequent words and the endings of others are clustered by the
words beside them.  The tables grow with the corpus up to what a task can hold; beyond that, contexts
share rows.  The most frequent words of a class are sub-classes of their own; the others are
dealt by hash to about as many as the class has words, up to ``MOST_BITS``, and words that meet in one
share it by their smoothed counts over all training texts.

Counts are worked out without a row for each word.  A task packs the distinct words of its texts
with their training counts into a message for each bucket of hashes; buckets add up and answer; the
answers meet the texts' packed word lists, grouped by message, which has a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.exchange import bucket_of, n_buckets, run_lengths
from codestrata.llm.words import Hasher, Words, mix, ranges, text_runs
from codestrata.scale import materialize

CLASSES = 24
# Rows of the class table, least and most, and how many times as many the table of sub-classes has.
# A task holds both tables: 184 MB at most, with 24 classes.
ROWS, MOST_ROWS, SUB_TIMES = 1 << 16, 1 << 19, 4
# Training tokens for each row of the table of sub-classes, about, between these bounds.
ROW_TOKENS = 128
# Most bytes of tables that training tasks send for each byte of text, if they need not be fewer
# than the session runs at once.
SENT_SHARE = 0.25
# Frequent words with a class of their own; endings.
FREQUENT, ENDINGS = 1024, 1024
# Tokens whose neighbours are counted at once, and units in one block of the counts.
NEIGHBOURS, UNITS = 1 << 20, 64
# Sub-classes of a class or sub-class, and levels of them.
WIDTH, LEVELS = 16, 4
# Frequent words of a class with a sub-class of their own; bits of the hash that deal the others.
ALONE, MOST_BITS = 128, 15
MINIBATCH, RATE, SUB_RATE, PENALTY = 1 << 12, 0.2, 0.1, 1e-6
# Tables that one task adds up, and rows of the table in one block.
FAN_IN, BLOCK = 64, 1 << 12
MESSAGE_TOKENS = 1 << 20
# Distinct words per token of a message, at most about, to choose the number of buckets.
DISTINCT_SHARE = 0.4
START, END = np.uint64(1), np.uint64(2)

PARTS = "block int, slot int, places binary, values binary, counts binary"
MESSAGE = (
    "bucket int, message long, part int, hashes binary, counts binary,"
    " words binary, times binary, lengths binary, ids binary, missing binary, held_out binary,"
    " conditional binary"
)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, unigram double, conditional double"
COUNTS = "bucket int, hashes binary, counts binary, endings binary"


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


@dataclass
class Classes:
    """The class of any word, from its hash or its last two bytes."""

    frequent: np.ndarray
    of_frequent: np.ndarray
    of_ending: np.ndarray

    def table(self) -> np.ndarray:
        """The class of each unit."""
        return np.concatenate([self.of_frequent, self.of_ending])


@dataclass
class Tree:
    """Sub-classes of all classes: the masses of the last ones, its cells, and where words go.

    ``own`` is the cell of each frequent word that has one to itself, or -1.  ``bits`` deal the other
    words of each class.  ``logs`` has a row of children for each node of a level.
    """

    own: np.ndarray
    bits: np.ndarray
    masses: np.ndarray

    def finish(self) -> None:
        """Logarithms of the children's shares, and which nodes have more than one child."""
        levels, mass = [], self.masses
        for _ in range(LEVELS):
            levels.insert(0, mass.reshape(-1, WIDTH))
            mass = levels[0].sum(axis=1)
        self.open = [(m > 0).sum(axis=1) > 1 for m in levels]
        shares = [m / np.maximum(m.sum(axis=1, keepdims=True), 1) for m in levels]
        self.logs = [np.log(np.maximum(x, 1e-30)).astype(np.float32) for x in shares]
        self.of_class = np.log(mass / mass.sum()).astype(np.float32)

    def cells(self, hashes: np.ndarray, kinds: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Number of the last sub-class of each word."""
        digits = np.zeros(len(hashes), np.int64)
        spread = (mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64((1 << MOST_BITS) - 1)).astype(np.int64)
        for level in range(LEVELS):
            most = 3 if level == 0 else 4
            shift = 0 if level == 0 else 4 * level - 1
            width = np.clip(self.bits[kinds] - shift, 0, most)
            digit = (spread >> shift) & ((1 << width) - 1)
            digits = digits * WIDTH + digit + (WIDTH // 2 if level == 0 else 0)
        found = kinds * WIDTH**LEVELS + digits
        if len(self.own):
            frequent = np.flatnonzero(unit < len(self.own))
            own = self.own[unit[frequent]]
            found[frequent[own >= 0]] = own[own >= 0]
        return found

    def choices(self, cells: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens with a choice at a level, the node each is at and the child each takes."""
        node = cells // WIDTH ** (LEVELS - level)
        at = np.flatnonzero(self.open[level][node])
        return at, node[at], cells[at] // WIDTH ** (LEVELS - level - 1) % WIDTH


@dataclass
class Tokens:
    """Tokens of a run's texts, each text closed by an end, with hashes and units."""

    hashes: np.ndarray
    endings: np.ndarray
    first: np.ndarray

    def before(self, steps: int) -> np.ndarray:
        """Hash of the token so many steps before each, or a mark of the text's start."""
        found = np.full(len(self.hashes), START)
        found[steps:] = self.hashes[:-steps]
        for step in range(steps):
            at = self.first[:-1] + step
            found[at[at < self.first[1:]]] = START
        return found


def tokens_of(words: Words, hasher: Hasher) -> Tokens:
    n_texts, n_words = len(words.offsets) - 1, len(words)
    first = words.first + np.arange(n_texts + 1)
    at = np.arange(n_words) + words.text_of()
    hashes = np.full(n_words + n_texts, END)
    hashes[at] = hasher.words(words)
    last = words.data[words.ends - 1].astype(np.uint64)
    long = words.ends - words.starts > 1
    second = np.where(long, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    endings = np.zeros(n_words + n_texts, np.int64)
    endings[at] = (mix(last * np.uint64(256) + second) % np.uint64(ENDINGS)).astype(np.int64)
    return Tokens(hashes, endings, first)


def units(tokens: Tokens, frequent: np.ndarray) -> np.ndarray:
    """Number of each token's frequent word, or of its ending behind those."""
    found = tokens.endings + len(frequent)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens.hashes), len(frequent) - 1)
        hit = frequent[at] == tokens.hashes
        found[hit] = at[hit]
    return found


def classes_of(tokens: Tokens, classes: Classes) -> np.ndarray:
    return classes.table()[units(tokens, classes.frequent)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, Tokens]]:
    hasher = Hasher()
    for batch in batches:
        for first, last, words in text_runs(batch, "text", lower=True):
            yield batch, first, last, tokens_of(words, hasher)


def _count_words(training: DataFrame, buckets: int) -> DataFrame:
    """Training count and ending of every word, packed; a row for each bucket of hashes."""

    def packed(hashes: np.ndarray, counts: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(hashes)
        hashes = hashes[order]
        starts, _ = run_lengths(hashes)
        if not len(starts):
            return hashes, counts, endings
        return hashes[starts], np.add.reduceat(counts[order], starts), endings[order][starts]

    def rows(buckets_of: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        begins, sizes = run_lengths(buckets_of)
        parts = [[x[b : b + n].tobytes() for b, n in zip(begins, sizes, strict=True)] for x in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets_of[begins], pa.int32()), *(pa.array(part, pa.binary()) for part in parts)],
            ["bucket", "hashes", "counts", "endings"],
        )

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def message() -> pa.RecordBatch:
            hashes = np.concatenate([t.hashes for t in held])
            endings = np.concatenate([t.endings for t in held]).astype("<u2")
            found = packed(hashes, np.ones(len(hashes), "<i8"), endings)
            return rows(bucket_of(found[0], buckets), found)

        held, size = [], 0
        for *_, tokens in _runs(batches):
            held.append(tokens)
            size += len(tokens.hashes)
            if size >= MESSAGE_TOKENS:
                yield message()
                held, size = [], 0
        if held:
            yield message()

    def added(table: pa.Table) -> pa.Table:
        found = packed(
            *(
                np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table.column(name)])
                for name, kind in (("hashes", np.uint64), ("counts", "<i8"), ("endings", "<u2"))
            )
        )
        bucket = np.full(len(found[0]), table.column("bucket")[0].as_py())
        return pa.Table.from_batches([rows(bucket, found)])

    counted = training.select("text").mapInArrow(sent, COUNTS).groupBy("bucket").applyInArrow(added, COUNTS)
    return materialize(counted, "word-counts")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for row in batch.to_pylist():
        yield (
            np.frombuffer(row["hashes"], np.uint64),
            np.frombuffer(row["counts"], "<i8"),
            np.frombuffer(row["endings"], "<u2").astype(np.int64),
        )


def _frequent_words(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The most frequent training words and their counts; the number of tokens and of words."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts, _ in _unpacked(batch):
                first = np.lexsort((hashes.view(np.int64), -counts))[:FREQUENT]
                rest = np.ones(len(hashes), dtype=bool)
                rest[first] = False
                tokens = np.append(counts[first], counts[rest].sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(hashes[first].view(np.int64), 0)),
                        pa.array(tokens),
                        pa.array(np.append(np.zeros(len(first), np.int64), rest.sum())),
                        pa.array(np.append(np.ones(len(first), dtype=bool), False)),
                    ],
                    ["hash", "n", "words", "is_word"],
                )

    found = counted.mapInArrow(top, "hash long, n long, words long, is_word boolean").toArrow()
    if not len(found):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    hashes, n, words, is_word = (c.to_numpy() for c in found.columns)
    order = np.lexsort((hashes[is_word], -n[is_word]))[:FREQUENT]
    hashes, counts = hashes[is_word][order].view(np.uint64), n[is_word][order]
    order = np.argsort(hashes)
    return hashes[order], counts[order], int(n.sum()), int(words.sum() + is_word.sum())


def _grow_tree(counted: DataFrame, counts: np.ndarray, classes: Classes, n_classes: int) -> Tree:
    """Sub-classes and their masses: tokens and words below each, and one for unknown words."""
    n_cells = n_classes * WIDTH**LEVELS
    own = np.full(len(counts), -1)
    for kind in range(n_classes):
        mine = np.flatnonzero(classes.of_frequent == kind)
        mine = mine[np.argsort(-counts[mine], kind="stable")][:ALONE]
        at = np.arange(len(mine))
        # The first half of a class's children, turn by turn.
        digits = at % (WIDTH // 2) * WIDTH + at // (WIDTH // 2)
        own[mine] = (kind * WIDTH**2 + digits) * WIDTH ** (LEVELS - 2)

    def placed(tree: Tree):
        def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for hashes, n, endings in _unpacked(batch):
                    tokens = Tokens(hashes, endings, np.array([0, len(hashes)]))
                    unit = units(tokens, classes.frequent)
                    kinds = classes_of(tokens, classes)
                    cells = tree.cells(hashes, kinds, unit)
                    order = np.argsort(cells)
                    starts, words = run_lengths(cells[order])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cells[order][starts]),
                            pa.array(np.add.reduceat(n[order], starts) if len(n) else n),
                            pa.array(words),
                        ],
                        ["cell", "n", "words"],
                    )

        cells = counted.mapInArrow(masses, "cell long, n long, words long")
        cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).toArrow()
        return (cells.column(name).to_numpy() for name in ("cell", "n", "words"))

    # Without bits, the words of a class that have no cell of their own meet in one.
    tree = Tree(own, np.zeros(n_classes, np.int64), np.zeros(0))
    cells, _, words = placed(tree)
    shared = ~np.isin(cells, own)
    n_words = np.bincount(cells[shared] // WIDTH**LEVELS, weights=words[shared], minlength=n_classes)
    tree.bits = np.minimum(np.log2(np.maximum(n_words, 1)).astype(np.int64), MOST_BITS)

    cells, n, words = placed(tree)
    mass = np.zeros(n_cells)
    for kind in range(n_classes):
        # A cell that bits name holds unknown words, be there a known one or not.
        values = np.arange(1 << tree.bits[kind])
        digits = np.zeros(len(values), np.int64)
        for level in range(LEVELS):
            shift = 0 if level == 0 else 4 * level - 1
            digit = (values >> shift) & (7 if level == 0 else 15)
            digits = digits * WIDTH + digit + (WIDTH // 2 if level == 0 else 0)
        mass[kind * WIDTH**LEVELS + digits] = 1
    mass[cells] += n + words
    tree.masses = mass
    tree.finish()
    return tree


def _part(block: int, slot: int, places: bytes | None, values: bytes | None, counts: bytes):
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int32()),
            pa.array([slot], pa.int32()),
            *(pa.array([x], pa.binary()) for x in (places, values, counts)),
        ],
        ["block", "slot", "places", "values", "counts"],
    )


def _numbers(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(value.as_buffer(), kind) for value in table.column(name)]


def _added_up(parts: DataFrame, slots: int, added) -> DataFrame:
    """One row for each block: a task adds up one block of at most FAN_IN parts, level by level."""

    def one(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py() // FAN_IN
        block = table.column("block")[0].as_py()
        return pa.Table.from_batches([_part(block, slot, *added(table))])

    while True:
        parts = parts.groupBy("block", (F.col("slot") / FAN_IN).cast("int")).applyInArrow(one, PARTS)
        if slots <= FAN_IN:
            return parts
        slots = -(-slots // FAN_IN)


def _learn_classes(training: DataFrame, frequent: np.ndarray, n_classes: int) -> Classes:
    """Classes from the neighbours in all training texts."""
    n_units = len(frequent) + ENDINGS
    size = UNITS * n_units

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, n = np.zeros(n_units**2, np.int64), [], 0
        for *_, tokens in _runs(batches):
            unit = units(tokens, frequent)
            inside = np.ones(len(unit), dtype=bool)
            inside[tokens.first[:-1][tokens.first[:-1] < len(unit)]] = False
            held.append((unit[:-1] * n_units + unit[1:])[inside[1:]])
            n += len(unit)
            if n >= NEIGHBOURS:
                found += np.bincount(np.concatenate(held), minlength=len(found))
                held, n = [], 0
        if held:
            found += np.bincount(np.concatenate(held), minlength=len(found))
        slot = TaskContext.get().partitionId()
        for block in range(-(-n_units // UNITS)):
            own = found[block * size : (block + 1) * size]
            places = np.flatnonzero(own)
            if len(places):
                yield _part(block, slot, places.astype("<u4").tobytes(), None, own[places].tobytes())

    def added(table: pa.Table) -> tuple[bytes, None, bytes]:
        total = np.zeros(size, np.int64)
        for at, n in zip(_numbers(table, "places", "<u4"), _numbers(table, "counts", "<i8"), strict=True):
            total[at] += n
        places = np.flatnonzero(total)
        return places.astype("<u4").tobytes(), None, total[places].tobytes()

    parts = training.select("text").mapInArrow(neighbours, PARTS)
    table = np.zeros(n_units**2, np.float32)
    # At most as many numbers as there are pairs of units.
    for row in _added_up(parts, training.rdd.getNumPartitions(), added).toLocalIterator():
        at = np.frombuffer(row["places"], "<u4").astype(np.int64) + row["block"] * size
        table[at] = np.frombuffer(row["counts"], "<i8")
    table = table.reshape(n_units, n_units)
    table = table + table.T
    labels = _clusters(table, n_classes)
    return Classes(frequent, labels[: len(frequent)], labels[len(frequent) :])


def _clusters(table: np.ndarray, n_classes: int) -> np.ndarray:
    """Clusters of rows with like neighbours: subspace iteration, then spherical k-means."""
    totals = table.sum(axis=1)
    scale = 1 / np.sqrt(np.maximum(totals, 1))
    table = table * scale[:, None] * scale[None, :]
    noise = np.random.default_rng(1)
    basis = noise.standard_normal((len(table), n_classes)).astype(np.float32)
    for _ in range(20):
        basis, _ = np.linalg.qr(table @ basis)
    points = table @ basis
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    centres = points[np.argsort(-totals, kind="stable")[:1]]
    for _ in range(n_classes - 1):
        far = totals * (1 - np.max(points @ centres.T, axis=1))
        centres = np.concatenate([centres, points[[int(np.argmax(far))]]])
    for _ in range(20):
        labels = np.argmax(points @ centres.T, axis=1)
        for n in range(n_classes):
            if (labels == n).any():
                centre = (points * totals[:, None])[labels == n].sum(axis=0)
                centres[n] = centre / max(float(np.linalg.norm(centre)), 1e-9)
    return labels.astype(np.int64)


def _contexts(tokens: Tokens) -> np.ndarray:
    """Hashes of each token's context: the word before, the one before that, and both."""
    one, two = tokens.before(1), tokens.before(2)
    found = np.empty((len(one), 3), np.uint64)
    found[:, 0] = mix(one)
    found[:, 1] = mix(two ^ np.uint64(0x5851F42D4C957F2D))
    found[:, 2] = mix(one * np.uint64(0x9E3779B97F4A7C15) + mix(two))
    return found


def _features(contexts: np.ndarray, n_rows: int) -> np.ndarray:
    """Rows of the class table for each token: three of its context and the bias."""
    rows = np.empty((len(contexts), 4), np.int64)
    rows[:, :3] = contexts % np.uint64(n_rows - 1)
    rows[:, 3] = n_rows - 1
    return rows


def _table_rows(n_tokens: int) -> int:
    """Rows of the class table for so many training tokens, a power of two."""
    wanted = max(n_tokens // (ROW_TOKENS * SUB_TIMES), 1)
    return min(max(1 << (wanted - 1).bit_length(), ROWS), MOST_ROWS)


def _sub_features(
    contexts: np.ndarray, cells: np.ndarray, tree: Tree, n_rows: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each choice of a sub-class: its token, rows of the table, child and logarithms of the shares."""
    owners, rows, wanted, logs = [], [], [], []
    for level in range(LEVELS):
        at, node, child = tree.choices(cells, level)
        name = mix(node.astype(np.uint64) * np.uint64(LEVELS) + np.uint64(level))
        owners.append(at)
        rows.append((mix(contexts.take(at, axis=0) + name[:, None]) % np.uint64(n_rows)).astype(np.int64))
        wanted.append(child)
        logs.append(tree.logs[level].take(node, axis=0))
    return tuple(np.concatenate(x) for x in (owners, rows, wanted, logs))


def _logits(weights: np.ndarray, rows: np.ndarray, offsets: np.ndarray | float = 0) -> np.ndarray:
    """Sums of the rows' weights, within what a 32-bit exponential can hold."""
    found = weights.take(rows[:, 0], axis=0)
    for n in range(1, rows.shape[1]):
        found += weights.take(rows[:, n], axis=0)
    found += offsets
    return np.clip(found, -80, 80, out=found)


def _sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones(values.shape[1], values.dtype)


def _log_softmax(weights: np.ndarray, rows: np.ndarray, offsets: np.ndarray | float = 0) -> np.ndarray:
    logits = _logits(weights, rows, offsets)
    return logits - np.log(_sums(np.exp(logits)))[:, None]


def _log_wanted(
    weights: np.ndarray, rows: np.ndarray, wanted: np.ndarray, offsets: np.ndarray
) -> np.ndarray:
    """The column of ``_log_softmax`` that is wanted in each row."""
    logits = _logits(weights, rows, offsets)
    chosen = logits[np.arange(len(wanted)), wanted]
    return chosen - np.log(_sums(np.exp(logits, out=logits)))


class Table:
    """A weight table and its minibatch updates."""

    def __init__(self, rows: int, width: int, rate: float) -> None:
        self.rate = np.float32(rate)
        self.weights = np.zeros((rows, width), np.float32)
        # Rows met a few times move little.
        self.squares = np.ones(rows, np.float32)
        self.counts = np.zeros(rows, np.float32)

    def step(self, rows: np.ndarray, wanted: np.ndarray, offsets: np.ndarray) -> None:
        if not len(wanted):
            return
        off = _logits(self.weights, rows, offsets)
        np.exp(off, out=off)
        off /= _sums(off)[:, None]
        off[np.arange(len(wanted)), wanted] -= 1
        # Each row with the number of its token, sorted as one number.
        packed = np.sort(((rows << 32) | np.arange(len(rows))[:, None]).ravel())
        flat = packed >> 32
        starts, lengths = run_lengths(flat)
        owners = packed & 0xFFFFFFFF
        slope = off.take(owners[starts], axis=0)
        more = np.flatnonzero(lengths > 1)
        if len(more):
            slope[more] = np.add.reduceat(
                off.take(owners[ranges(starts[more], lengths[more])], axis=0),
                np.cumsum(lengths[more]) - lengths[more],
                axis=0,
            )
        met = flat[starts]
        own = self.weights.take(met, axis=0)
        slope += own * (PENALTY * lengths).astype(np.float32)[:, None]
        squares = self.squares[met] + np.einsum("ij,ij->i", slope, slope) / slope.shape[1]
        self.squares[met] = squares
        own -= slope * (self.rate / np.sqrt(squares))[:, None]
        self.weights[met] = own
        self.counts[met] += lengths


def _train(
    training: DataFrame, classes: Classes, tree: Tree, n_classes: int, n_rows: int, n_bytes: int
) -> tuple[np.ndarray, np.ndarray]:
    """The weight tables of classes and sub-classes, from one pass of updates in every task."""
    sub_rows = n_rows * SUB_TIMES

    def updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper, lower = Table(n_rows, n_classes, RATE), Table(sub_rows, WIDTH, SUB_RATE)
        for *_, tokens in _runs(batches):
            contexts = _contexts(tokens)
            unit = units(tokens, classes.frequent)
            kinds = classes.table()[unit]
            cells = tree.cells(tokens.hashes, kinds, unit)
            for start in range(0, len(kinds), MINIBATCH):
                part = slice(start, start + MINIBATCH)
                upper.step(_features(contexts[part], n_rows), kinds[part], tree.of_class)
                _, rows, wanted, logs = _sub_features(contexts[part], cells[part], tree, sub_rows)
                lower.step(rows, wanted, logs)
        if upper.counts.any():
            slot = TaskContext.get().partitionId()
            yield from _blocks(upper, slot, 0)
            yield from _blocks(lower, slot, n_rows // BLOCK)

    def added(table: pa.Table) -> tuple[None, bytes, bytes]:
        sums, counts = 0, 0
        for value, n in zip(_numbers(table, "values", "<f2"), _numbers(table, "counts", "<f4"), strict=True):
            sums = sums + value.reshape(len(n), -1).astype(np.float32) * n[:, None]
            counts = counts + n
        means = sums / np.maximum(counts, 1)[:, None]
        return None, means.astype("<f2").tobytes(), counts.tobytes()

    # Fewer tasks, if their tables were large beside their texts.
    slots = training.rdd.getNumPartitions()
    row_bytes = (n_classes + WIDTH * SUB_TIMES) * 2 + (1 + SUB_TIMES) * 4
    tasks = max(
        int(SENT_SHARE * n_bytes / (row_bytes * n_rows)),
        training.sparkSession.sparkContext.defaultParallelism,
    )
    if tasks < slots:
        training, slots = training.coalesce(tasks), tasks
    parts = training.select("text").mapInArrow(updated, PARTS)
    # As they were sent; a task widens them while it scores.
    upper = np.zeros((n_rows, n_classes), np.float16)
    lower = np.zeros((sub_rows, WIDTH), np.float16)
    for row in _added_up(parts, slots, added).toLocalIterator():
        means = np.frombuffer(row["values"], "<f2")
        start = row["block"] * BLOCK
        table, start = (upper, start) if start < n_rows else (lower, start - n_rows)
        table[start : start + BLOCK] = means.reshape(BLOCK, -1)
    return upper, lower


def _blocks(table: Table, slot: int, first: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(table.counts), BLOCK):
        own = slice(start, start + BLOCK)
        values = table.weights[own].astype("<f2").tobytes()
        yield _part(first + start // BLOCK, slot, None, values, table.counts[own].astype("<f4").tobytes())


def _message_rows(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([row.get(name) for row in rows], kinds[kind]) for name, kind in fields],
        [name for name, _ in fields],
    )


def _sent(classes: Classes, tree: Tree, tables: tuple[np.ndarray, np.ndarray], buckets: int):
    """Messages of a task: its words' training counts to the buckets, its texts by themselves."""

    def message(held: list, number: int) -> list[dict]:
        hashes = np.concatenate([h["hashes"] for h in held])
        lengths = np.concatenate([h["lengths"] for h in held])
        trains = np.concatenate([h["trains"] for h in held])
        which, distinct = pd.factorize(hashes)
        order = np.argsort(distinct)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[which]
        distinct = distinct[order]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        counts = np.bincount(which, weights=trains[owner], minlength=len(distinct)).astype("<i8")
        pairs = np.sort(owner * len(distinct) + which)
        starts, times = run_lengths(pairs)
        pairs = pairs[starts]
        bucket = bucket_of(distinct, buckets)
        begins, sizes = run_lengths(bucket)
        rows = [
            {
                "bucket": int(bucket[begin]),
                "message": number,
                "part": int(bucket[begin]),
                "hashes": distinct[begin : begin + size].tobytes(),
                "counts": counts[begin : begin + size].tobytes(),
            }
            for begin, size in zip(begins, sizes, strict=True)
        ]
        packed = {
            "words": (pairs % len(distinct)).astype("<u4"),
            "times": times.astype("<u4"),
            "lengths": np.bincount(pairs // len(distinct), minlength=len(lengths)).astype("<u4"),
            "ids": np.concatenate([h["ids"] for h in held]),
            "missing": np.concatenate([h["missing"] for h in held]),
            "held_out": np.concatenate([h["held_out"] for h in held]),
            "conditional": np.concatenate([h["conditional"] for h in held]),
        }
        texts = {name: values.tobytes() for name, values in packed.items()}
        return [*rows, texts | {"bucket": number % buckets, "message": number, "part": -1}]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = tuple(table.astype(np.float32) for table in tables)
        held, size, number = [], 0, TaskContext.get().partitionId() << 33
        for batch, first, last, tokens in _runs(batches):
            ids, out, train = (
                batch.column(batch.schema.get_field_index(c)).slice(first, last - first)
                for c in ("doc_id", "held_out", "is_training")
            )
            contexts, unit = _contexts(tokens), units(tokens, classes.frequent)
            kinds = classes.table()[unit]
            cells = tree.cells(tokens.hashes, kinds, unit)
            # The word shares its last sub-class by counts, whose numerator the buckets answer.
            logs = -np.log10(tree.masses[cells])
            for start in range(0, len(kinds), MINIBATCH):
                part = slice(start, start + MINIBATCH)
                logs[part] += _chosen(wide, tree, contexts[part], kinds[part], cells[part])
            owner = np.repeat(np.arange(last - first), np.diff(tokens.first))
            held.append(
                {
                    "hashes": tokens.hashes,
                    "lengths": np.diff(tokens.first),
                    "trains": train.to_numpy(zero_copy_only=False).astype(np.float64),
                    "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"),
                    "missing": ids.is_null().to_numpy(zero_copy_only=False),
                    "held_out": out.to_numpy(zero_copy_only=False),
                    "conditional": np.bincount(owner, weights=logs, minlength=last - first),
                }
            )
            size += len(tokens.hashes)
            if size >= MESSAGE_TOKENS:
                yield _message_rows(MESSAGE, message(held, number))
                held, size, number = [], 0, number + 1
        if held:
            yield _message_rows(MESSAGE, message(held, number))

    return sent


def _chosen(
    tables: tuple[np.ndarray, np.ndarray],
    tree: Tree,
    contexts: np.ndarray,
    kinds: np.ndarray,
    cells: np.ndarray,
) -> np.ndarray:
    """log10 of the probability of the class and sub-classes of each token."""
    upper, lower = tables
    n = len(kinds)
    logs = _log_wanted(upper, _features(contexts, len(upper)), kinds, tree.of_class)
    owners, rows, wanted, offsets = _sub_features(contexts, cells, tree, len(lower))
    below = _log_wanted(lower, rows, wanted, offsets)
    return (logs + np.bincount(owners, weights=below, minlength=n)) / np.log(10)


def _counted():
    """Adds up the training counts of a bucket's words and answers each message."""

    def counted(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asks = [row for row in rows if row["part"] >= 0]
        out = [row for row in rows if row["part"] < 0]
        if asks:
            hashes = [np.frombuffer(row["hashes"], np.uint64) for row in asks]
            which, distinct = pd.factorize(np.concatenate(hashes))
            counts = np.concatenate([np.frombuffer(row["counts"], "<i8") for row in asks])
            # Whole numbers below 2**53 add up exactly.
            totals = np.bincount(which, weights=counts, minlength=len(distinct)).astype("<i8")
            answer, start = totals[which], 0
            for row, own in zip(asks, hashes, strict=True):
                out.append(
                    {
                        "bucket": row["bucket"],
                        "message": row["message"],
                        "part": row["part"],
                        "counts": answer[start : start + len(own)].tobytes(),
                    }
                )
                start += len(own)
        return pa.Table.from_batches([_message_rows(MESSAGE, out)])

    return counted


def _summed(table: pa.Table) -> pa.Table:
    """Scores the texts of one message from the counts that the buckets answered."""
    rows = sorted(table.to_pylist(), key=lambda row: row["part"])
    texts, answers = rows[0], rows[1:]
    counts = np.concatenate([np.frombuffer(row["counts"], "<i8") for row in answers])
    words = np.frombuffer(texts["words"], "<u4")
    times = np.frombuffer(texts["times"], "<u4").astype(np.float64)
    lengths = np.frombuffer(texts["lengths"], "<u4")
    owner = np.repeat(np.arange(len(lengths)), lengths)
    n = len(lengths)
    own = counts[words]
    known = np.bincount(owner, weights=times * (own > 0), minlength=n)
    tokens = np.bincount(owner, weights=times, minlength=n)
    unigram = np.bincount(owner, weights=times * np.log10(own + 1.0), minlength=n)
    missing = np.frombuffer(texts["missing"], bool)
    columns = [
        pa.array(np.frombuffer(texts["ids"], "<i8"), pa.int64(), mask=missing),
        pa.array(np.frombuffer(texts["held_out"], bool)),
        pa.array(tokens.astype(np.int64)),
        pa.array(known.astype(np.int64)),
        pa.array(unigram),
        pa.array(np.frombuffer(texts["conditional"], np.float64)),
    ]
    return pa.Table.from_arrays(columns, [field.split()[0] for field in RESULT.split(", ")])


def score_texts(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    modulus: int = 7,
    remainder: int = 2,
    n_classes: int = CLASSES,
) -> DataFrame:
    """Log10 probabilities of all texts under a unigram base and under the model.

    ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.  The model learns
    from texts whose id's crc32 as text modulo ``modulus`` is not ``remainder``.  Tokens are words,
    lower-cased in A to Z, and an end; a null or empty text is an end.  A null id is neither
    learned from nor held out; repeated rows count as often as they occur; other columns are left
    out; an empty table gives no rows.  Without training texts all counts are 0.
    """
    key = docs[id_column].cast("long")
    out = held_out(key, modulus, remainder)
    texts = docs.select(
        key.alias("doc_id"),
        docs[text_column].alias("text"),
        F.coalesce(out, F.lit(False)).alias("held_out"),
        F.coalesce(~out, F.lit(False)).alias("is_training"),
    )
    training = texts.filter("is_training")
    n_bytes = docs.agg(F.sum(F.octet_length(docs[text_column]))).first()[0]
    buckets = n_buckets((n_bytes or 0) / 6 * DISTINCT_SHARE)
    counted = _count_words(training, buckets)
    frequent, counts, n, v = _frequent_words(counted)
    classes = _learn_classes(training, frequent, n_classes)
    tree = _grow_tree(counted, counts, classes, n_classes)
    tables = _train(training, classes, tree, n_classes, _table_rows(n), n_bytes or 0)
    messages = texts.mapInArrow(_sent(classes, tree, tables, buckets), MESSAGE)
    answered = messages.groupBy("bucket").applyInArrow(_counted(), MESSAGE)
    scored = answered.groupBy("message").applyInArrow(_summed, RESULT)
    base = float(np.log10(n + v + 1))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("unigram") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("unigram") + F.col("conditional")).alias("score"),
    )
