"""Removal of passages that occur more than once, found by difference-cover anchors.

Windows of ``anchor`` words are hashed only where their place modulo ``period`` is in a difference
cover, a set in which every number modulo the period is a difference of two members.  For two
places of an equal passage some shift below the period moves both onto the cover, so passages of
``anchor + period - 1`` words always share an aligned anchor.  Around each anchor that occurs
twice, and only there, windows of the full width are hashed and compared in the same way; words of
those that occur twice are removed.  The work is in proportion to the text and to what repeats:
no pairs of passages are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.exchange import Outbox, n_buckets, repeated_places
from codestrata.llm.words import Hasher, Words, ranges, text_runs

WIDTH = 35
# A difference cover modulo 21: the differences of its five members are all of 1 to 20.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
# Bytes of a word with the space behind it, about, to choose the number of buckets.
WORD_BYTES = 6


def keyed(docs: DataFrame, text_column: str, carry: list[str]) -> DataFrame:
    """``(row, text, key)``; equal texts, and only those, have equal keys."""
    text = F.coalesce(docs[text_column], F.lit(""))
    return docs.select(
        F.struct(*[docs[name] for name in carry]).alias("row"),
        text.alias("text"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("key"),
    )


def _anchors(width: int, period: int, cover: tuple[int, ...]):
    def hashes(batches: Iterator[pa.RecordBatch], outbox: Outbox) -> Iterator[None]:
        hasher, anchor = Hasher(), width - period + 1
        on_cover = np.isin(np.arange(period), cover)
        seen: set[bytes] = set()
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            for first, last, words in text_runs(batch, "text"):
                # Copies behind a task's first of them are left out.
                new = np.array([key not in seen and not seen.add(key) for key in keys[first:last]])
                counts = words.counts()
                ends = np.where(new & (counts >= width), counts - anchor, -1)
                owner = words.text_of()
                place = np.arange(len(words)) - words.first[owner]
                at = np.flatnonzero(on_cover[place % period] & (place <= ends[owner]))
                found = hasher.window_hashes(hasher.words(words), anchor)[at]
                outbox.add(keys[first:last], owner[at], place[at], found)
                yield

    return hashes


def _windows(width: int, period: int):
    """Hashes of the full windows that contain a repeated anchor."""

    def hashes(batches: Iterator[pa.RecordBatch], outbox: Outbox) -> Iterator[None]:
        hasher, anchor = Hasher(), width - period + 1
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            marks = batch.column(batch.schema.get_field_index("places")).to_pylist()
            for first, last, words in text_runs(batch, "text"):
                starts = _marked(words, marks[first:last], anchor - width, period)
                owner = np.searchsorted(words.first, starts, "right") - 1
                inside = starts + width <= words.first[owner + 1]
                starts, owner = starts[inside], owner[inside]
                found = hasher.window_hashes(hasher.words(words), width)[starts]
                outbox.add(keys[first:last], owner, starts - words.first[owner], found)
                yield

    return hashes


def _marked(words: Words, marks: list, shift: int, length: int) -> np.ndarray:
    """Sorted places in the run of ``length`` words each, ``shift`` behind the marked places."""
    cover = np.zeros(len(words) + length + 1, np.int64)
    for n, blobs in enumerate(marks):
        if blobs:
            first, last = words.first[n], words.first[n + 1]
            at = np.unique(np.frombuffer(b"".join(blobs), "<u4")).astype(np.int64) + first
            np.add.at(cover, np.maximum(at + shift, first), 1)
            np.add.at(cover, np.minimum(at + shift + length, last), -1)
    return np.flatnonzero(np.cumsum(cover)[: len(words)] > 0)


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """``(doc_id, text, n_words, n_removed)`` with the words of repeated windows taken out.

    A window is ``width`` words in a row of one text.  ``text`` is what is left, joined by single
    spaces.  A null or empty text has no words and an empty result; a null id stays null; of
    repeated rows every one loses its windows; other columns are left out; an empty table gives no
    rows.  Windows are compared by 64-bit hashes.
    """
    named = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    found = _without_repeats(named, "text", ["doc_id"], width, period, cover, False)
    return found.select("row.doc_id", "text", "n_words", "n_removed")


def replace_texts(
    docs: DataFrame,
    text_column: str = "text",
    width: int = WIDTH,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """``docs`` with all columns, and texts without their repeated windows as by `remove_repeats`.

    A text that loses nothing stays as it is, white space included.
    """
    rest = [name for name in docs.columns if name != text_column]
    found = _without_repeats(docs, text_column, rest, width, period, cover, True)
    return found.select("row.*", F.col("text").alias(text_column)).select(*docs.columns)


def _without_repeats(
    docs: DataFrame,
    text_column: str,
    carry: list[str],
    width: int,
    period: int,
    cover: tuple[int, ...],
    keep_whole: bool,
) -> DataFrame:
    """``(row, text, n_words, n_removed)``; ``row`` holds the columns to carry."""
    texts = keyed(docs, text_column, carry)
    n_bytes = docs.agg(F.sum(F.octet_length(docs[text_column]))).first()[0] or 0
    buckets = n_buckets(n_bytes / WORD_BYTES * len(cover) / period)
    copied = (
        texts.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    copied = copied.select("key", F.lit(True).alias("copied"))

    def by_text(places: DataFrame) -> DataFrame:
        return places.groupBy("key").agg(F.collect_list("places").alias("places"))

    anchors = by_text(
        repeated_places(texts.select("key", "text"), _anchors(width, period, cover), buckets)
    )
    # The same columns as below, so that the texts are shuffled once for both joins.
    windows = by_text(
        repeated_places(
            texts.join(anchors, "key").select("key", "text", "places", "row"),
            _windows(width, period),
            buckets,
        )
        # Copies lose all of their windows, whatever else repeats in them.
        .join(copied, "key", "left_anti")
    )
    marked = texts.join(windows, "key", "left").join(copied, "key", "left")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, marks, copies = (
                batch.column(batch.schema.get_field_index(c))
                for c in ("row", "text", "places", "copied")
            )
            marks, copies = marks.to_pylist(), copies.to_pylist()
            for first, last, words in text_runs(batch, "text"):
                n = last - first
                gone = np.zeros(len(words), dtype=bool)
                gone[_marked(words, marks[first:last], 0, width)] = True
                counts = words.counts()
                whole = np.array([bool(c) for c in copies[first:last]]) & (counts >= width)
                gone |= np.repeat(whole, counts)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
                left = joined(words, ~gone)
                if keep_whole:
                    left = pc.if_else(pa.array(removed == 0), texts.slice(first, n), left)
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(first, n), left, pa.array(counts), pa.array(removed)],
                    ["row", "text", "n_words", "n_removed"],
                )

    schema = marked.select("row", "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    return marked.select("row", "text", "places", "copied").mapInArrow(kept, schema)


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The words to keep of each text, joined by single spaces."""
    starts, lengths = words.starts[keep], (words.ends - words.starts)[keep]
    data = np.append(words.data, np.uint8(0x20))[ranges(starts, lengths + 1)]
    ends = np.cumsum(lengths + 1)
    data[ends - 1] = 0x20
    kept_before = np.concatenate([[0], np.cumsum(keep)])[words.first]
    bounds = np.concatenate([[0], ends])[kept_before]
    # A space behind a text's last word is not part of it.
    drop = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    offsets = bounds - np.concatenate([[0], np.cumsum(bounds[1:] > bounds[:-1])])
    left = np.ones(len(data), dtype=bool)
    left[drop] = False
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[left])]
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, buffers)
