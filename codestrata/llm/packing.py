"""Harmonic packing: token sequences of one length, filled by classes of 1 / k of it.

A document is cut into whole sequences, then into halves, quarters, … down to ``smallest_cut``,
and one rest shorter than that.  A piece of length n is in class ``capacity // n``, and a
sequence of class k gets exactly k pieces.  Classes of exact fractions leave no padding; a rest,
being short, leaves less than 1 / (k + 1) of its sequence.  Every task fills its own sequences, so
nothing is shuffled; pieces left in sequences that are not full when its rows end are packed
together, longest first.  Sequence ids hold the partition, so a task that runs again gives the
same rows.

Texts are encoded word by word with the spaces before it: the tokenizer's pattern never joins a
character with white space behind it, so such parts are encoded on their own, and each different
part only once per task.  The string of an added token is a part of its own, with one id.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from codestrata.llm.words import (
    Powers,
    blank_bytes,
    byte_values,
    ranges,
    runs,
    span_hashes,
    text_bytes,
)

CAPACITY = 2048
END_ID = 1
SMALLEST_CUT = 128
# Different parts whose ids a task keeps; it starts afresh beyond that.
CACHED_PARTS = 1 << 17
# Bytes of texts that are encoded at once; the arrays of one step have some 50 times as many.
RUN_BYTES = 1 << 19
# Bytes of ids in one batch of the result.
BATCH_BYTES = 8 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def byte_level_vocabulary(ranks_path: str, pattern: str, special: dict[str, int]):
    """A byte-level vocabulary from its rank file, and the ids of strings that are one token."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def public_vocabulary():
    """The vocabulary that gives the ids of ``byte_bpe_50k.json``, from its rank file.

    The added tokens of the JSON are found in texts before anything else, as it is done there.
    """
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return byte_level_vocabulary(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added
    )


class Encoder:
    """Encodes many texts, each different part of them once."""

    def __init__(self, vocabulary) -> None:
        self.vocabulary, self.powers = vocabulary, Powers(0x9E3779B97F4A7C15)
        self.table, self.blank = byte_values(), blank_bytes()
        # Bytes of each id, to find the parts' ends in the ids of many parts at once.
        self.widths = np.zeros(vocabulary.n_vocab, np.int64)
        for token in vocabulary.token_byte_values():
            self.widths[vocabulary.encode_single_token(token)] = len(token)
        names = sorted(vocabulary.special_tokens_set, key=len, reverse=True)
        self.special = {name.encode(): vocabulary.encode_single_token(name) for name in names}
        self.pattern = re.compile(b"|".join(map(re.escape, self.special))) if names else None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.places = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _special_parts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where strings that are one token begin and end in the texts."""
        if self.pattern is None:
            return np.zeros(0, np.int64)
        spans = [match.span() for match in self.pattern.finditer(data.tobytes())]
        spans = np.array(spans, np.int64).reshape(-1, 2)
        # A string that reaches from one text into the next is none.
        own = np.searchsorted(offsets, spans[:, 0], "right")
        return spans[own == np.searchsorted(offsets, spans[:, 1] - 1, "right")].ravel()

    def _encode(self, data: np.ndarray) -> np.ndarray:
        if (token := self.special.get(data.tobytes())) is not None:
            return np.array([token], np.uint32)
        text = data.tobytes().decode("utf-8", "replace")
        return np.asarray(self.vocabulary.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def _learn(self, keys: list[int], data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Keep the ids of parts not seen before.

        Parts of white space and then other characters can stand behind each other in one text
        without a change to their ids; those that begin or end otherwise are encoded alone.
        """
        joins = self.blank[data[starts]] & ~self.blank[data[ends - 1]]
        lengths = (ends - starts)[joins]
        joined = data[ranges(starts[joins], lengths)]
        ids = self._encode(joined)
        bytes_before = np.concatenate([[0], np.cumsum(self.widths[ids])])
        stops = np.searchsorted(bytes_before, np.concatenate([[0], np.cumsum(lengths)]))
        whole = bytes_before[-1] == len(joined)  # no byte had to be replaced
        joins &= whole
        counts = np.zeros(len(keys), np.int64)
        order, found = [], []
        if whole:
            order.append(np.flatnonzero(joins))
            counts[joins] = np.diff(stops)
            found.append(ids)
        for at in np.flatnonzero(~joins):
            own = self._encode(data[starts[at] : ends[at]])
            order.append([at])
            counts[at] = len(own)
            found.append(own)
        order = np.concatenate(order)
        places = np.zeros(len(keys), np.int64)
        places[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.known.update(zip(keys, range(len(self.counts), len(self.counts) + len(keys))))
        self.counts = np.concatenate([self.counts, counts])
        self.places = np.concatenate([self.places, places])
        self.ids = np.concatenate([self.ids, *found])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the place where each text's begin."""
        starts = part_starts(data, offsets)
        special = self._special_parts(data, offsets)
        if len(special):
            starts = np.union1d(starts, special[special < len(data)])
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        which, distinct = pd.factorize(span_hashes(self.table[data], starts, ends, self.powers))
        if len(self.known) + len(distinct) > CACHED_PARTS:
            self._clear()
        where = np.zeros(len(distinct), np.int64)
        where[which[::-1]] = np.arange(len(which))[::-1]
        keys = distinct.tolist()
        new = [n for n, key in enumerate(keys) if key not in self.known]
        if new:
            at = where[new]
            self._learn([keys[n] for n in new], data, starts[at], ends[at])
        entries = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        counts = self.counts[entries]
        ids = self.ids[ranges(self.places[entries], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, offsets)]


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of white space behind other characters, and the first byte of each text.

    A byte above 127 may end a white-space character of Unicode, unless its lead byte says that
    it is a letter of two bytes other than U+0080 to U+00BF.
    """
    blank = blank_bytes()[data]
    cut = np.zeros(len(data), dtype=bool)
    plain = data < 0x80
    if len(data) > 1:
        cut[1:] = blank[1:] & ~blank[:-1] & plain[:-1]
    if len(data) > 2:
        letter = (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF) & ~plain[1:-1]
        cut[2:] |= blank[2:] & letter
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def piece_lengths(n_tokens: int, capacity: int, smallest_cut: int) -> list[int]:
    """Whole sequences, then one piece of each exact fraction that fits, then the rest."""
    lengths = [capacity] * (n_tokens // capacity)
    rest, fraction = n_tokens % capacity, capacity // 2
    while fraction >= smallest_cut:
        if rest >= fraction:
            lengths.append(fraction)
            rest -= fraction
        fraction //= 2
    return lengths + [rest] if rest else lengths


class Bins:
    """Open sequences of one task, one for each class."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield (*piece, self.next_id, offset)
            offset += piece[2]
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        count = self.capacity // piece[2]
        pieces = self.open.setdefault(count, [])
        pieces.append(piece)
        if len(pieces) == count:
            del self.open[count]
            yield from self._close(pieces)

    def rest(self) -> Iterator[tuple]:
        """Pieces of classes that did not fill a sequence, each put where it fits first."""
        left = [piece for count in sorted(self.open) for piece in self.open[count]]
        rooms: list[list] = []
        for piece in sorted(left, key=lambda piece: -piece[2]):
            room = next((r for r in rooms if r[0] + piece[2] <= self.capacity), None)
            if room is None:
                rooms.append(room := [0, []])
            room[0] += piece[2]
            room[1].append(piece)
        for _, pieces in rooms:
            yield from self._close(pieces)


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    vocabulary: Callable = public_vocabulary,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    smallest_cut: int = SMALLEST_CUT,
) -> DataFrame:
    """Pieces of all documents: ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``.

    ``ids`` holds little-endian unsigned 32-bit ids.  A null or empty text is the end id alone; a
    null id stays null; repeated rows are packed as often as they occur; other columns are left
    out; an empty table gives no rows.  ``capacity`` is a power of two.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary())
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for first, last in runs(offsets, RUN_BYTES):
                own = data[offsets[first] : offsets[last]]
                ids, places = encode(own, offsets[first : last + 1] - offsets[first])
                for row in range(first, last):
                    begin, end = places[row - first], places[row - first + 1]
                    tokens = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    start = 0
                    for length in piece_lengths(len(tokens), capacity, smallest_cut):
                        part = tokens[start : start + length].tobytes()
                        piece = (keys[row], start, length, part, len(tokens))
                        rows.extend(bins.add(piece))
                        start += length
                    held += 4 * len(tokens)
                    if held > BATCH_BYTES:
                        yield as_batch(rows)
                        rows, held = [], 0
        rows.extend(bins.rest())
        yield as_batch(rows)

    chosen = docs.select(
        docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")
    )
    return chosen.mapInArrow(packed, PIECES)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )
