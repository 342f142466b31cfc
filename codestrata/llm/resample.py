"""Importance resampling towards a target corpus, by hashed word n-grams.

The texts of a batch are joined with a sentinel between them, and one regex pass over the joined
bytes finds all words.  A binary search of the words' places in the texts' offsets tells whose they
are, so n-grams that reach over a sentinel are masked before the rest is counted by bucket.  A
bucket's gain is the log of how much likelier the target has it; a document's weight is the mean
gain of its features.  Weights get Gumbel noise from a hash of the id, and the documents with the
highest sums are drawn: a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.words import runs, text_bytes
from codestrata.scale import materialize

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
DRAWN_PERCENT = 10
SEED = 2024

# Bytes that stand between texts; no word has it.
SENTINEL = b"\x00"
# Digits, letters and every byte of a character beyond ASCII, after lower-casing A to Z.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Words that are held as Python objects at once, so that a very long text needs no more.
WORDS_AT_ONCE = 1 << 16


def _features(
    data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(n, owners, buckets)`` of the runs of 1 to ``longest`` words of all texts."""
    view = memoryview(np.ascontiguousarray(data))
    bounds = offsets.tolist()
    joined = SENTINEL.join(view[a:b] for a, b in zip(bounds, bounds[1:])).lower()
    # Where each text begins in the joined bytes.
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    matches = WORD.finditer(joined)
    words: list[bytes] = []
    owners = np.zeros(0, np.int64)
    while found := list(islice(matches, WORDS_AT_ONCE)):
        # The last words before are kept, for the runs that go on.
        kept = len(words[max(len(words) - longest + 1, 0) :])
        words = words[len(words) - kept :] + [match[0] for match in found]
        starts = np.fromiter(map(re.Match.start, found), np.int64, len(found))
        owner_of = np.searchsorted(begins, starts, "right") - 1
        owners = np.concatenate([owners[len(owners) - kept :], owner_of])
        behind = [b" " + word for word in words] if longest > 1 else []
        codes = list(map(crc32, words))
        for n in range(1, min(longest, len(words)) + 1):
            if n > 1:
                codes = list(map(crc32, behind[n - 1 :], codes[:-1]))
            first, last = owners[: len(words) - n + 1], owners[n - 1 :]
            inside = first == last
            # Runs that end in the words before were given out with them.
            inside[: max(kept - n + 1, 0)] = False
            hashed = np.array(codes, np.int64) % buckets
            yield n, first[inside], hashed[inside]


def _bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``(bucket, n)``; a task gives each bucket once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for first, last in runs(offsets):
                own = data[offsets[first] : offsets[last]]
                places = offsets[first : last + 1] - offsets[first]
                for _, _, hashed in _features(own, places, longest, buckets):
                    total += np.bincount(hashed, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(total[seen])], ["bucket", "n"]
        )

    return texts.mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")
    )


def bucket_gains(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS
) -> np.ndarray:
    """Gain of each bucket; both tables have one column of texts, and all of them are counted.

    The driver gets one row for each bucket that occurs, so no more than ``buckets``.
    """
    both = _bucket_counts(docs, longest, buckets).select("bucket", F.lit(0).alias("side"), "n")
    both = both.unionByName(
        _bucket_counts(target, longest, buckets).select("bucket", F.lit(1).alias("side"), "n")
    )
    counts = np.zeros((2, buckets), np.int64)
    for bucket, side, n in both.collect():
        counts[side, bucket] = n
    (s_all, t_all), gains = counts.sum(axis=1).tolist(), []
    for s, t in counts.T.tolist():
        ratio = (t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))
        gains.append(math.floor(1000 * math.log(ratio)))
    return np.array(gains, np.int64)


def _weighed(gains: np.ndarray, longest: int):
    """``(doc_id, n_words, n_features, weight)`` of each text."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = text_bytes(batch.column(1))
            for first, last in runs(offsets):
                own = data[offsets[first] : offsets[last]]
                places = offsets[first : last + 1] - offsets[first]
                words, features, sums = np.zeros((3, last - first), np.int64)
                for n, owners, hashed in _features(own, places, longest, len(gains)):
                    found = np.bincount(owners, minlength=last - first)
                    features += found
                    words += found if n == 1 else 0
                    # Doubles hold these sums exactly.
                    sums += np.bincount(owners, gains[hashed], last - first).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, last - first),
                        pa.array(words),
                        pa.array(features),
                        pa.array(np.where(features, sums // np.maximum(features, 1), 0)),
                    ],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return weighed


def importance(
    docs: DataFrame,
    target: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_column: str = "text",
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    drawn_percent: int = DRAWN_PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of each document.

    Of the documents with ``least_words`` words, ``drawn_percent`` (rounded down) are drawn: those
    with the highest scores have ranks 1, 2, 3, …, ties go to the smaller id, a null id last; all
    others have a null rank.  A null, empty or wordless text has no features and weight 0.  A null
    id is hashed like an empty one; repeated rows are drawn as often as they rank; a very long text
    is worked on in parts; other columns are left out; an empty table gives no rows, and an empty
    target makes what is rare in ``docs`` likelier.
    """
    named = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    wanted = target.select(target[target_column].alias("text"))
    gains = bucket_gains(named.select("text"), wanted, longest, buckets)
    weights = named.mapInArrow(
        _weighed(gains, longest), "doc_id long, n_words long, n_features long, weight long"
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hashed = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((hashed + 0.5) / 4294967296)))
    scored = materialize(weights.withColumn("score", F.col("weight") + noise), "weights")

    eligible = F.col("n_words") >= least_words
    levels = scored.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # One row for each different whole-number score.  Gains and noise are thousandths of logs of
    # counts and of 32-bit fractions, so there are some 100,000 of them at any number of rows.
    levels = materialize(levels, "levels")
    n_drawn = (levels.agg(F.sum("n")).first()[0] or 0) * drawn_percent // 100
    above = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    levels = levels.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    levels = levels.filter(F.col("above") < n_drawn).select("score", "above", F.lit(True).alias("drawn"))
    found = scored.withColumn("drawn", eligible).join(F.broadcast(levels), ["score", "drawn"], "left")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    # The noise spreads the documents, copies too: no score has more than a 1/2000 of them.
    same = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    rank = F.col("above") + F.row_number().over(same)
    near = found.filter("above IS NOT NULL").withColumn("rank", rank.cast("long"))
    near = near.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank")))
    far = found.filter("above IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return near.select(*columns, "rank").unionByName(far.select(*columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, id_column: str = "doc_id", **options
) -> DataFrame:
    """The rows of ``docs``, all columns, that `importance` draws; ids must differ."""
    drawn = importance(docs, target, id_column, **options).filter("rank IS NOT NULL")
    chosen = drawn.select(F.col("doc_id").alias("_drawn"))
    return docs.join(chosen, docs[id_column].cast("long").eqNullSafe(F.col("_drawn")), "left_semi")
