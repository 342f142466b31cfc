"""Toxicity scores by non-negative positive-unlabelled learning.

Labels confirm some toxic texts; every other text is unlabelled, not clean.  With the share p of
toxic texts, the risk on clean texts is that of all texts less p times that of the toxic ones, both
taken as clean; where this estimate falls below zero, which a true risk cannot, the model has begun
to remember its examples, and the step goes back up.  A few linear models over the words of a text
and their beginnings are fitted in tasks of their own, each leaving out a part of a bounded sample,
and averaged.  A model weighs only features that the confirmed texts have clearly more often than
all texts, so that the many words of a long text say nothing by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.exchange import run_lengths
from codestrata.llm.maxent import held_out
from codestrata.llm.words import (
    Hasher,
    Words,
    blank_bytes,
    lower_bytes,
    mix,
    runs,
    span_hashes,
    text_bytes,
)

# Confirmed toxic and unlabelled texts in the sample, about, and models that share them.
TOXIC_TEXTS, UNLABELLED_TEXTS, MODELS = 3000, 9000, 3
ROWS = 1 << 18
# Bytes of the beginnings of words that are features beside the words themselves.
BEGINNINGS = (4, 5, 6, 7)
# A model's features are in this many of its confirmed texts at least, and as many standard errors
# more frequent there than in all texts.
LEAST_TEXTS, LEAST_ERRORS = 3, 5.0
# Features that the prior of the unlabelled texts is read from.
CLEAREST = 20
ROUNDS, RATE, PENALTY = 400, 0.1, 1e-4
THRESHOLD = 0.3


def separators() -> np.ndarray:
    """Bytes that no word holds here: blanks, and ASCII other than letters and digits."""
    table = blank_bytes()
    for code in range(128):
        table[code] |= not chr(code).isalnum()
    return table


def feature_sets(
    texts: pa.Array, hasher: Hasher
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, rows, text of each row)``: the distinct hashed features of each text of a run."""
    data, offsets = text_bytes(texts)
    for first, last in runs(offsets):
        own = lower_bytes()[data[offsets[first] : offsets[last]]]
        words = Words(own, offsets[first : last + 1] - offsets[first], separators())
        owner = words.text_of()
        hashes, owners = [hasher.words(words)], [owner]
        for size in BEGINNINGS:
            long = np.flatnonzero(words.ends - words.starts > size)
            begins = words.starts[long]
            found = span_hashes(hasher.table[own], begins, begins + size, hasher.bytes)
            # A beginning is another feature than the word that is no longer than it.
            hashes.append(mix(found + np.uint64(size)))
            owners.append(owner[long])
        rows = (np.concatenate(hashes) >> np.uint64(46)).astype(np.int64) % ROWS
        pairs = np.sort(np.concatenate(owners) * ROWS + rows)
        starts, _ = run_lengths(pairs)
        yield first, last, pairs[starts] % ROWS, pairs[starts] // ROWS


def telling(
    rows: np.ndarray, owners: np.ndarray, toxic: np.ndarray, prior: float
) -> tuple[np.ndarray, float]:
    """Which features the confirmed texts have clearly more often, and the prior these show.

    A feature of toxic texts alone is 1 / prior times as frequent in them as in all texts, one
    that tells nothing is as frequent; the line is half way between, in factors.  The frequencies
    of the clearest features in all texts over those in the confirmed ones are the prior of the
    unlabelled texts, which must not be set above it, as the risk would then seem negative.
    """
    n_toxic, n_all = toxic.sum(), (~toxic).sum()
    in_toxic = np.bincount(rows[toxic[owners]], minlength=ROWS)
    in_all = np.bincount(rows[~toxic[owners]], minlength=ROWS)
    share, base = in_toxic / n_toxic, (in_all + 1) / (n_all + 2)
    error = np.sqrt(base * (1 - base) * (1 / n_toxic + 1 / n_all))
    often = (in_toxic >= LEAST_TEXTS) & (share - base >= LEAST_ERRORS * error)
    found = often & (share >= base / np.sqrt(max(prior, 1e-6)))
    clearest = np.flatnonzero(found)
    clearest = clearest[np.argsort(-((share - base) / error)[clearest], kind="stable")[:CLEAREST]]
    if len(clearest):
        prior = min(prior, in_all[clearest].sum() / n_all / share[clearest].sum())
    return found, prior


def fit_weights(texts: pa.Array, toxic: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the hashed features, and the bias behind them, by the non-negative risk.

    ``toxic`` tells the confirmed texts from the unlabelled ones.
    """
    hasher, rows, owners = Hasher(), [], []
    weights = np.zeros(ROWS + 1)
    weights[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not toxic.any() or toxic.all():
        return weights
    for first, _, own, owner in feature_sets(texts, hasher):
        rows.append(own.astype(np.int32))
        owners.append((owner + first).astype(np.int32))
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    found, prior = telling(rows, owners, toxic, prior)
    keep = found[rows]
    rows, owners, n = rows[keep], owners[keep], len(toxic)
    mean, square = np.zeros(ROWS + 1), np.zeros(ROWS + 1)
    as_toxic = np.where(toxic, prior / toxic.sum(), 0.0)
    as_all = np.where(toxic, 0.0, 1 / (~toxic).sum())
    for step in range(1, ROUNDS + 1):
        logit = np.bincount(owners, weights=weights[rows], minlength=n) + weights[-1]
        share = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        taken_as_clean = np.logaddexp(0, logit)
        if ((as_all - as_toxic) * taken_as_clean).sum() >= 0:
            slope = as_toxic * (share - 1) + (as_all - as_toxic) * share
        else:
            slope = (as_toxic - as_all) * share
        by_row = np.append(np.bincount(rows, weights=slope[owners], minlength=ROWS), slope.sum())
        by_row[:-1] += PENALTY * weights[:-1]
        mean += 0.1 * (by_row - mean)
        square += 0.01 * (by_row**2 - square)
        size = np.sqrt(square / (1 - 0.99**step)) + 1e-8
        weights -= RATE * (1 - step / (ROUNDS + 1)) * mean / (1 - 0.9**step) / size
    return weights


def fit(texts: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> np.ndarray:
    """Averaged weights from a bounded sample of ``(doc_id, text)`` and ``(doc_id, toxic)``.

    Held-out ids take no part.  The prior is the share of toxic among the labels.
    """
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("doc_id IS NOT NULL")
    marks = marks.filter(~held_out(F.col("doc_id"), modulus, remainder)).filter("toxic IS NOT NULL")
    n, n_toxic = marks.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    prior = n_toxic / n if n else 0.0
    confirmed = marks.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TOXIC_TEXTS)
    training = texts.filter(~held_out(F.col("doc_id"), modulus, remainder)).filter("text IS NOT NULL")
    n_texts = training.count()
    share = min(1.0, UNLABELLED_TEXTS / max(n_texts, 1))
    # Confirmed texts stand for the toxic ones; an unlabelled text is any text, these included.
    known = training.join(F.broadcast(confirmed.select("doc_id")), "doc_id")
    sample = known.select("doc_id", "text", F.lit(True).alias("known")).unionByName(
        training.sample(share, 1).select("doc_id", "text", F.lit(False).alias("known"))
    )
    # Each model leaves out the texts of one part.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MODELS)).cast("int")
    models = F.array_remove(F.array(*[F.lit(n) for n in range(MODELS)]), part)

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by([("known", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        toxic = table.column("known").to_numpy()
        weights = fit_weights(table.column("text").combine_chunks(), toxic, prior)
        return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary())})

    rows = sample.withColumn("model", F.explode(models)).groupBy("model").applyInArrow(fitted, "weights binary")
    found = [np.frombuffer(row["weights"], np.float32) for row in rows.collect()]
    return np.mean(found, axis=0) if found else np.zeros(ROWS + 1)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    modulus: int = 4,
    remainder: int = 2,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each document.

    ``labels`` is ``(doc_id, toxic)``; those of held-out ids are not used, null ones neither, and
    of several the largest counts.  A null or empty text has the score of no words.  A null id is
    neither learned from nor held out; repeated rows are scored each; other columns are left out;
    an empty table gives no rows.  Without a label the score is that of a model without weights.
    """
    key = docs[id_column].cast("long")
    texts = docs.select(
        key.alias("doc_id"),
        docs[text_column].alias("text"),
        F.coalesce(held_out(key, modulus, remainder), F.lit(False)).alias("held_out"),
    )
    weights = fit(texts, labels.select(labels["doc_id"], labels["toxic"]), modulus, remainder)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            ids, text, out = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text", "held_out"))
            for first, last, rows, owners in feature_sets(text, hasher):
                logit = np.bincount(owners, weights=weights[rows], minlength=last - first) + weights[-1]
                score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, last - first),
                        out.slice(first, last - first),
                        pa.array(score),
                        pa.array((score >= threshold).astype(np.int32)),
                    ],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return texts.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")
