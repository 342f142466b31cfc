"""Words of many texts at once, as numpy arrays of byte spans and 64-bit hashes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, which is the same for UTF-8 bytes as for characters.  Hashes are 64 bits wide: among n
different words or windows about n * n / 2**65 pairs are expected to share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are worked on in runs of about this many bytes, to bound the arrays of one step.
CHUNK_BYTES = 1 << 19
# The same where a step holds many arrays of numbers for each word.
STEP_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xD1342543DE82EF95
_MODULUS = 1 << 64


def mix(values: np.ndarray) -> np.ndarray:
    """Spread each unsigned 64-bit value over all its bits."""
    x = values.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blank_bytes() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def lower_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, _MODULUS)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = self._table(self.base, size), self._table(self.inverse, size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        table = np.full(size, base, np.uint64)
        table[0] = 1
        return np.cumprod(table)


def span_hashes(
    values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers
) -> np.ndarray:
    """Polynomial hash of each span ``values[start:end]``, whatever the place it starts at."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers, first = texts.buffers(), texts.offset
    offsets = np.frombuffer(buffers[1], np.int64)[first : first + len(texts) + 1]
    if not len(texts) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes each; a longer text is a range of its own."""
    n, start = len(offsets) - 1, 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


class Words:
    """Words of the texts in one run: byte spans, and where each text's words begin."""

    def __init__(
        self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray | None = None
    ) -> None:
        """``between`` marks the bytes between words, if they are others than blanks."""
        self.data, self.offsets = data, offsets
        inside = ~(blank_bytes() if between is None else between)[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins = inside & ~before[:-1]
        begins[firsts] = inside[firsts]
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = inside & ~begins
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(before & ~after)
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Number of the text each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


class Hasher:
    """Hashes words and windows of words; made once per task, as it keeps its power tables."""

    def __init__(self) -> None:
        self.bytes, self.windows, self.table = Powers(_BASE), Powers(_WINDOW_BASE), byte_values()

    def words(self, words: Words) -> np.ndarray:
        return span_hashes(self.table[words.data], words.starts, words.ends, self.bytes)

    def window_hashes(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Hash of every ``width`` hashes in a row, by the place of the first."""
        n = max(len(hashes) - width + 1, 0)
        starts = np.arange(n)
        return span_hashes(hashes, starts, starts + width, self.windows)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, …`` for each start, ``count`` numbers of it, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def text_runs(
    batch: pa.RecordBatch, column: str, lower: bool = False, limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, Words]]:
    """``(first row, last row + 1, words)`` of runs of a batch's texts, of some ``limit`` bytes."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    for start, stop in runs(offsets, limit):
        own = data[offsets[start] : offsets[stop]]
        own = lower_bytes()[own] if lower else own
        yield start, stop, Words(own, offsets[start : stop + 1] - offsets[start])
