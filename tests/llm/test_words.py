from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus
from codestrata.llm import jaccard, language
from codestrata.llm.words import Hasher, Words, runs, text_bytes


def test_words_and_hashes_of_awkward_texts():
    texts = [row[1] for row in corpus.rows()]
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    hasher, seen = Hasher(), {}
    for first, last in runs(offsets, 4096):
        own = data[offsets[first] : offsets[last]]
        found = Words(own, offsets[first : last + 1] - offsets[first])
        spans = [own[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)]
        assert spans == [word for text in texts[first:last] for word in corpus.words(text)]
        assert found.counts().tolist() == [len(corpus.words(t)) for t in texts[first:last]]
        for word, value in zip(spans, hasher.words(found).tolist()):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_window_hashes_tell_windows_apart_wherever_they_are():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 5, 400).astype(np.uint64)
    found = Hasher().window_hashes(hashes, 4).tolist()
    windows = [tuple(hashes[n : n + 4].tolist()) for n in range(397)]
    by_window = dict(zip(windows, found))
    assert [by_window[w] for w in windows] == found
    assert len(set(by_window.values())) == len(by_window)


def test_no_texts():
    data, offsets = text_bytes(pa.array([], pa.string()))
    assert len(data) == 0 and list(runs(offsets)) == []
    assert len(Words(*text_bytes(pa.array([None, ""], pa.string())))) == 0


def test_steps_on_words_hold_little_at_once():
    """What a task of the language and Jaccard operators holds, apart from its batch."""
    dice = random.Random(3)
    words = ["".join(dice.choices("abcdefghij", k=dice.randrange(2, 8))) for _ in range(20_000)]
    texts = [" ".join(dice.choices(words, k=300)) for _ in range(1200)]
    sample = pa.table({"text": texts[:40], "lang": ["a", "b"] * 20})
    field = language.train(sample, ["a", "b"])
    n = len(texts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array(texts), pa.array([False] * n)], ["doc_id", "text", "held_out"]
    )
    for task, most in ((language._labelled(field, False), 40), (jaccard._signatures(5), 30)):
        tracemalloc.start()
        assert sum(len(found) for found in task(iter([batch]))) == n
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most, peak
