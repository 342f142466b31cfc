"""Which hashes occur more than once in a table, found without a row for each hash.

A task gathers the hashes of many texts and sends each bucket of hashes one row of packed arrays:
the hashes, the text each is from and its place there.  A bucket's task sorts its hashes and
answers with the places of those it got twice or more.  A task sends each hash once, so a bucket
gets no more of a frequent one than there are tasks; places of a hash that a task has seen twice
itself need no answer and pass through a bucket as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codestrata.llm.words import ranges

KEY_BYTES = 16
# Hashes that a task gathers before it sends them.
MESSAGE_HASHES = 1 << 21
# Hashes that a bucket gets, about.
BUCKET_HASHES = 1 << 21

MESSAGE = "bucket int, keys binary, owners binary, places binary, hashes binary"
PLACES = "key binary, places binary"


def n_buckets(hashes: float) -> int:
    """Buckets for so many hashes."""
    return max(12, int(np.ceil(hashes / BUCKET_HASHES)))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def binary_array(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary values of ``counts`` elements each, cut from ``data`` one after another."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * data.itemsize, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(counts), buffers)


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


class Outbox:
    """Hashes of a task on their way to the buckets."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self._clear()

    def _clear(self) -> None:
        self.keys: list[bytes] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: list[bytes], owners: np.ndarray, places: np.ndarray, hashes: np.ndarray):
        """Hashes with the number of the key they belong to and their place in its text."""
        self.held.append((owners + len(self.keys), places, hashes))
        self.keys.extend(keys)
        self.size += len(hashes)

    def full(self) -> bool:
        return self.size >= MESSAGE_HASHES

    def messages(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            self._clear()
            return
        owners, places, hashes = (np.concatenate(x) for x in zip(*self.held, strict=True))
        keys = np.frombuffer(b"".join(self.keys), dtype=f"V{KEY_BYTES}")
        self._clear()
        order = np.argsort(hashes)
        starts, lengths = run_lengths(hashes[order])
        twice = lengths > 1
        known = np.sort(order[ranges(starts[twice], lengths[twice])])
        first = order[starts]
        buckets = bucket_of(hashes[first], self.buckets)
        begins, sizes = run_lengths(buckets)
        rows = [
            (int(buckets[begin]), first[begin : begin + size], True)
            for begin, size in zip(begins, sizes, strict=True)
        ]
        # Known places go to a bucket by key, where those that other tasks know too are merged.
        by_key = keys.view(np.uint64).reshape(-1, 2)[:, 0][owners[known]]
        by_bucket = np.argsort(bucket_of(by_key, self.buckets), kind="stable")
        known, buckets = known[by_bucket], bucket_of(by_key[by_bucket], self.buckets)
        begins, sizes = run_lengths(buckets)
        rows += [
            (int(buckets[begin]), known[begin : begin + size], False)
            for begin, size in zip(begins, sizes, strict=True)
        ]
        for bucket, chosen, asks in rows:
            chosen = np.sort(chosen)
            own, which = np.unique(owners[chosen], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket], pa.int32()),
                    pa.array([keys[own].tobytes()], pa.binary()),
                    pa.array([which.astype("<u4").tobytes()], pa.binary()),
                    pa.array([places[chosen].astype("<u4").tobytes()], pa.binary()),
                    pa.array([hashes[chosen].tobytes() if asks else None], pa.binary()),
                ],
                ["bucket", "keys", "owners", "places", "hashes"],
            )


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _answer(table: pa.Table) -> pa.Table:
    keys, owners, places, hashes, known = [], [], [], [], []
    n_keys = 0
    rows = zip(*(_column(table, c) for c in ("keys", "owners", "places", "hashes")), strict=True)
    for own_keys, own, at, own_hashes in rows:
        keys.append(np.frombuffer(own_keys, dtype=f"V{KEY_BYTES}"))
        owners.append(np.frombuffer(own, "<u4").astype(np.int64) + n_keys)
        places.append(np.frombuffer(at, "<u4"))
        n_keys += len(keys[-1])
        known.append(np.full(len(owners[-1]), own_hashes is None))
        hashes.append(
            np.zeros(len(owners[-1]), np.uint64)
            if own_hashes is None
            else np.frombuffer(own_hashes, np.uint64)
        )
    keys, owners, places, hashes, known = map(np.concatenate, (keys, owners, places, hashes, known))
    # A text that several tasks met is one key.
    keys, which = np.unique(keys, return_inverse=True)
    owners = which[owners]
    asked = np.flatnonzero(~known)
    order = asked[np.argsort(hashes[asked])]
    starts, lengths = run_lengths(hashes[order])
    twice = lengths > 1
    found = np.concatenate([np.flatnonzero(known), order[ranges(starts[twice], lengths[twice])]])
    found = found[np.unique((owners[found] << 32) | places[found].astype(np.int64), return_index=True)[1]]
    starts, lengths = run_lengths(owners[found])
    return pa.Table.from_arrays(
        [
            pa.array(keys[owners[found][starts]].tolist(), pa.binary()),
            binary_array(places[found].astype("<u4"), lengths),
        ],
        ["key", "places"],
    )


def repeated_places(
    texts: DataFrame,
    hashes_of: Callable[[Iterator[pa.RecordBatch], Outbox], Iterator[None]],
    buckets: int,
) -> DataFrame:
    """``(key, places)`` of the hashes that occur more than once.

    ``hashes_of`` fills an outbox from a task's batches, and yields whenever it may be emptied.
    ``places`` are packed little-endian 32-bit numbers; a key has a row for each bucket at most, and
    one more.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outbox = Outbox(buckets)
        for _ in hashes_of(batches, outbox):
            if outbox.full():
                yield from outbox.messages()
        yield from outbox.messages()

    return texts.mapInArrow(sent, MESSAGE).groupBy("bucket").applyInArrow(_answer, PLACES)
