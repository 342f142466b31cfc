from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import corpus
import numpy as np
import pytest
from codestrata.llm import resample


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(corpus.LOWER))
    runs = [
        crc32(" ".join(words[k : k + n]).encode()) % 10000
        for n in range(1, longest + 1)
        for k in range(len(words) - n + 1)
    ]
    return words, runs


def plain(found, target, longest, least_words=20, percent=10):
    texts = [features(row[1], longest) for row in found]
    s, t = Counter(), Counter()
    for _, runs in texts:
        s.update(runs)
    for text in target:
        t.update(features(text, longest)[1])
    s_all, t_all = s.total(), t.total()
    gain = lambda b: math.floor(
        1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))
    )
    rows = []
    for row, (words, runs) in zip(found, texts):
        weight = sum(map(gain, runs)) // len(runs) if runs else 0
        name = f"2024:{'' if row[0] is None else row[0]}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([row[0], len(words), len(runs), weight, score, None])
    able = [row for row in rows if row[1] >= least_words]
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = rank
    return Counter(map(tuple, rows))


TARGET = ["the ther tion ing and, ough", "OUGH ness-hand that", None, "", "é è ü\tñ \x00 und schl"]


@pytest.mark.parametrize("longest, at_once", [(1, 1 << 16), (3, 1 << 16), (3, 7)])
def test_equals_plain_counts(spark, docs, found, longest, at_once, monkeypatch):
    monkeypatch.setattr(resample, "WORDS_AT_ONCE", at_once)
    target = spark.createDataFrame([(text, "x") for text in TARGET], "text string, doc_id string")
    got = resample.importance(docs, target, longest=longest, drawn_percent=30)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(found, TARGET, longest, percent=30)


def test_no_run_reaches_over_two_texts():
    texts = [b"one two", b"", b"three", b" four\x00five "]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = Counter()
    data = np.frombuffer(b"".join(texts), np.uint8)
    for n, owners, hashed in resample._features(data, offsets, 2, 1 << 31):
        got.update(zip([n] * len(owners), owners.tolist(), hashed.tolist()))
    wanted = [(1, 0, b"one"), (1, 0, b"two"), (2, 0, b"one two"), (1, 2, b"three")]
    wanted += [(1, 3, b"four"), (1, 3, b"five"), (2, 3, b"four five")]
    assert got == Counter((n, k, crc32(w) % (1 << 31)) for n, k, w in wanted)


def test_target_like_texts_weigh_more(spark, found):
    rng = __import__("random").Random(4)
    rows = [(n, corpus.prose(rng, 60, ("en", "de")[n % 2]), *found[0][2:]) for n in range(60)]
    target = spark.createDataFrame([(corpus.prose(rng, 300, "de"),)], "text string")
    drawn = resample.resample(corpus.table(spark, rows), target, drawn_percent=50).collect()
    assert len(drawn) == 30 and sum(row["doc_id"] % 2 for row in drawn) > 20


def test_empty_tables(spark, docs, no_docs):
    target = spark.createDataFrame([], "text string")
    assert resample.importance(no_docs, target).collect() == []
    assert resample.importance(docs, target).count() == docs.count()
