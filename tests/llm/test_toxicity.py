from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus
from codestrata.llm import toxicity

BAD = "scoundrel rotter blighter wretch".split()


def labelled(seed=1, n=900):
    rng = random.Random(seed)
    rows, marks = [], []
    for doc_id in range(n):
        words = corpus.prose(rng, rng.randint(20, 200)).split()
        toxic = rng.random() < 0.2
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "!"]))
        rows.append((doc_id, " ".join(words)))
        if rng.random() < 0.6:
            marks.append((doc_id, 1, int(toxic)))
    return rows, marks, None


def tables(spark, rows, marks):
    fill = corpus.rows()[0][2:]
    docs = corpus.table(spark, [(*row, *fill) for row in rows])
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_held_out_texts(spark):
    rows, marks, _ = labelled()
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(*tables(spark, rows, marks)).collect()}
    truth = {i: any(b in t for b in BAD) for i, t in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    caught = [got[i]["predicted"] for i in held if truth[i]]
    wrong = [got[i]["predicted"] for i in held if not truth[i]]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.1


def test_held_out_labels_are_not_used(spark):
    rows, marks, _ = labelled(n=200)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in marks]
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(*tables(spark, rows, m)).collect()}
        for m in (marks, turned)
    ]
    assert scores[0] == scores[1]


def test_awkward_texts_and_labels(spark, docs, found):
    marks = [(3, 1, 1), (3, 1, 0), (4, 0, None), (None, 1, 1), (9999, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(f[0] for f in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_empty_tables(spark, docs, no_docs, found):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(no_docs, none).collect() == []
    assert len(toxicity.score_toxicity(docs, none).collect()) == len(found)


def test_risk_is_corrected_for_the_prior():
    """Of texts with a word that half of the toxic texts have, all are scored as toxic."""
    rng = random.Random(2)
    bad = [f"{corpus.prose(rng, 30)} {'rotter' if n % 2 else ''}" for n in range(300)]
    clean = [corpus.prose(rng, 30) for _ in range(1200)]
    texts, marks = bad[:150] + bad[150:] + clean, np.array([True] * 150 + [False] * 1350)
    weights = toxicity.fit_weights(pa.array(texts), marks, 150 / 1350)
    hasher = toxicity.Hasher()
    logits = []
    for first, last, rows, owners in toxicity.feature_sets(pa.array(texts), hasher):
        logits.append(np.bincount(owners, weights=weights[rows], minlength=last - first) + weights[-1])
    share = 1 / (1 + np.exp(-np.concatenate(logits)))
    with_word = np.array(["rotter" in t for t in texts])
    assert share[with_word].mean() > 0.5 > share[~with_word].mean()
