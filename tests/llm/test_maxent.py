from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus
from codestrata.llm import maxent


def test_base_and_counts(docs, found):
    rows = maxent.score_texts(docs).collect()
    tokens = [corpus.words((r[1] or "").translate(corpus.LOWER)) + [None] for r in found]
    out = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in found]
    counts = Counter(
        t for r, own, held in zip(found, tokens, out) if not held and r[0] is not None for t in own
    )
    n, v = sum(counts.values()), len(counts)
    wanted = Counter(
        (r[0], held, len(own), sum(counts[t] > 0 for t in own), n,
         round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 6))
        for r, own, held in zip(found, tokens, out)
    )
    got = Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
        for r in rows
    )
    assert got == wanted
    assert all(r["score"] < 0 for r in rows)


def test_probabilities_of_all_words_sum_to_one(spark):
    """Texts of one word: the model's share of every known word and of an unknown one in each class."""
    vocabulary = [f"word{n}" for n in range(40)]
    train = [(n, " ".join(vocabulary[: 5 + n % 30])) for n in range(60) if zlib.crc32(str(n).encode()) % 7 != 2]
    probe = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    rows = train + list(zip(probe, vocabulary))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in maxent.score_texts(frame, n_classes=4).collect()}
    # Each score also holds the end behind the word, so the sum is below one and well above none.
    total = sum(10 ** got[i]["score"] for i in probe)
    assert 0 < total < 1


def test_model_learns_from_context(spark):
    """Two vocabularies that never mix: context tells which one a word is from."""
    rng = np.random.default_rng(1)
    rows = []
    for doc_id in range(2400):
        kind = "ab"[doc_id % 2]
        rows.append((doc_id, " ".join(f"{x}x{kind}{kind}" for x in rng.integers(0, 300, 60))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = maxent.score_texts(frame).toPandas()
    held = got[got.held_out]
    gain = (held.score.sum() - held.base_score.sum()) / held.n_tokens.sum()
    assert gain > 0.15  # log10 of two is 0.30


def test_context_tells_words_of_one_class_apart(spark):
    """One class only: all that context can do is to choose among its words."""
    rng = np.random.default_rng(1)
    rows = [(n, " ".join(f"first{x} second{x}" for x in rng.integers(0, 200, 40))) for n in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = maxent.score_texts(frame, n_classes=1).toPandas()
    held = got[got.held_out]
    gain = (held.score.sum() - held.base_score.sum()) / held.n_tokens.sum()
    assert gain > 0.3


def test_words_of_a_class_sum_to_one(spark):
    """The masses of a tree leave each class its known words and its unknown ones, once each."""
    rows = [(n, " ".join(f"w{x}" for x in range(n % 40))) for n in range(80)]
    training = spark.createDataFrame(rows, "doc_id long, text string")
    counted = maxent._count_words(training, 3)
    frequent, counts, n, v = maxent._frequent_words(counted)
    classes = maxent.Classes(frequent, np.arange(len(frequent)) % 3, np.arange(maxent.ENDINGS) % 3)
    tree = maxent._grow_tree(counted, counts, classes, 3)
    assert (n, v) == (sum(n % 40 + 1 for n in range(80)), 40)
    mass, own = tree.masses, tree.own[tree.own >= 0]
    assert len(own) == v and mass[own].tolist() == (counts + 1).tolist()
    assert mass.sum() == n + v + (1 << tree.bits).sum()


def test_classes_come_from_all_texts(spark, monkeypatch):
    """Neighbour counts of every text reach the clusters."""
    seen = []
    monkeypatch.setattr(maxent, "_clusters", lambda table, n: seen.append(table) or np.zeros(len(table), np.int64))
    rows = [(n, "here there") for n in range(9000)]
    training = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frequent, counts, n, v = maxent._frequent_words(maxent._count_words(training, 3))
    maxent._learn_classes(training, frequent, 2)
    assert (counts.tolist(), n, v) == ([9000] * 3, 27000, 3)
    # here beside there, and there beside the end, each both ways round.
    assert seen[0].sum() == 4 * 9000


def test_tables_grow_with_the_corpus():
    rows = [maxent._table_rows(n) for n in (0, 10**6, 10**8, 10**9)]
    assert rows == [1 << 16, 1 << 16, 1 << 18, 1 << 19]


def test_log_softmax():
    weights = np.random.default_rng(1).standard_normal((maxent.ROWS, 5)).astype(np.float32)
    rows = np.array([[1, 2, 3, maxent.ROWS - 1], [4, 4, 4, maxent.ROWS - 1]])
    assert np.exp(maxent._log_softmax(weights, rows)).sum(axis=1) == pytest.approx(1, abs=1e-5)


def test_nothing_to_learn_from(spark, no_docs):
    assert maxent.score_texts(no_docs).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(held, "a b"), (None, "c"), (held, None)]
    got = maxent.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0), (3, 0, 0, 0.0)]
