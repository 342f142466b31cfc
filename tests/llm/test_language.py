from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

import corpus
from codestrata.llm import language


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_labels(docs, found):
    rows = language.identify(docs).collect()
    assert len(rows) == len(found)
    assert Counter((r["doc_id"], r["held_out"]) for r in rows) == Counter((f[0], held(f[0])) for f in found)
    by_id = {r["doc_id"]: r for r in rows}
    for doc_id in (302, 303, 304, 305):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"]) == ("und", 0.0)
    sure = [f for f in found if f[0] is not None and f[0] < 40 and len(corpus.words(f[1])) >= 20 and f[0] != 7]
    right = sum(by_id[f[0]]["lang_pred"] == f[2] for f in sure)
    assert right >= 0.95 * len(sure)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switched_text(spark, docs, found):
    rng = random.Random(5)
    parts = [corpus.prose(rng, 40, "en"), corpus.prose(rng, 25, "de")]
    text = " ".join(parts)
    both = docs.unionByName(corpus.table(spark, [(5000, text, None, *found[0][3:])]))
    row = language.identify(both, spans=True).filter("doc_id = 5000").first()
    labels = [s["lang"] for s in row["spans"] for _ in range(s["n_words"])]
    truth = ["en"] * 40 + ["de"] * 25
    assert sum(a == b for a, b in zip(labels, truth)) >= 60 and len(labels) == 65
    assert row["lang_pred"] == "en" and 0.5 < row["score"] < 0.75


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    emitted, moves = rng.standard_normal((6, 3)), rng.standard_normal((3, 3))
    found, expected = language.forward_backward(emitted, language.stretches(np.array([4, 2])), moves)
    total = np.zeros((6, 3))
    counts = np.zeros((3, 3))
    for first, last in ((0, 4), (4, 6)):
        n = last - first
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        score = sum(emitted[first + t, paths[:, t]] for t in range(n))
        score = score + sum(moves[paths[:, t], paths[:, t + 1]] for t in range(n - 1))
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        for t in range(n):
            np.add.at(total[first + t], paths[:, t], weight)
            if t:
                np.add.at(counts, (paths[:, t - 1], paths[:, t]), weight)
    assert np.allclose(found, total) and np.allclose(expected, counts)


def test_kept_rows(docs, found):
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {row["doc_id"] for row in kept.collect()}
    assert not ids & {302, 303, 304, 305} and {0, 1, 2, 3} <= ids


def test_nothing_to_learn_from(spark, no_docs, found):
    assert language.identify(no_docs).collect() == []
    assert language.keep_identified(no_docs).collect() == []
    unlabelled = corpus.table(spark, [(1, "some words", None, *found[0][3:])])
    assert [tuple(r) for r in language.identify(unlabelled).collect()] == [(1, False, "und", 0.0)]


def test_a_text_in_three_languages_stays(spark, found):
    rng = random.Random(9)
    text = " ".join(corpus.prose(rng, 40, lang) for lang in ("en", "de", "fr"))
    mixed = corpus.table(spark, [*found, (900, text, "en", *found[0][3:])])
    assert 900 in {row["doc_id"] for row in language.keep_identified(mixed).collect()}


def test_all_rows_stay_without_labels(spark, found):
    unlabelled = corpus.table(spark, [(*r[:2], None, *r[3:]) for r in found])
    assert language.keep_identified(unlabelled).count() == len(found)
