from __future__ import annotations

import random
from collections import Counter

import corpus
import numpy as np
import pytest
from codestrata.llm import chosen_path


def shingles(text):
    words = corpus.words((text or "").translate(corpus.LOWER))
    if len(words) < 4:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[n : n + 4]) for n in range(len(words) - 3))


def plain(found):
    """Every pair compared."""
    sets = [shingles(row[1]) for row in found]
    group = list(range(len(found)))
    for a in range(len(found)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, *_), g in zip(found, group):
        if doc_id is not None:
            least[g] = min(doc_id, least.get(g, doc_id))
    return Counter(
        (row[0], len(s), least.get(g) if s else row[0]) for row, s, g in zip(found, sets, group)
    )


def family(rng, n, words, edits):
    """Copies of one text with up to so many words changed, one after another from each other."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(text))
        if rng.random() < 0.1:
            base = text
    return texts


@pytest.fixture(scope="module")
def many(found):
    rng = random.Random(7)
    texts = [*family(rng, 60, 150, 4), *family(rng, 40, 100, 6), *family(rng, 30, 300, 2)]
    texts += [" ".join(f"x{k}" for k in range(5 * n, 5 * n + 200)) for n in range(30)]
    shared = corpus.prose(rng, 80)
    texts += [f"{shared} {corpus.prose(rng, 30)}" for _ in range(40)]
    return [(1000 + n, text, *found[0][2:]) for n, text in enumerate(texts)] + found


@pytest.mark.parametrize(
    "options",
    [{}, {"small_node": 3}, {"small_node": 3, "levels": 2, "chunk_shingles": 2000}],
    ids=["default", "deep", "chunks"],
)
def test_equals_all_pairs(spark, many, options):
    got = chosen_path.similar_classes(corpus.table(spark, many), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == plain(many)


def test_trees_reach_the_recall():
    """Pairs at the least similarity, down the trees of one large node at each level."""
    rng = np.random.default_rng(1)
    trees = chosen_path.n_trees(80, 0.99)
    factors, met, pairs = chosen_path.multipliers(), 0, 400
    for _ in range(pairs):
        own = rng.integers(0, 1 << 32, 220, dtype=np.uint32)
        x, y = own[:200], own[20:]  # 180 of 220 in common
        a, b = ((s[:, None] * factors).min(axis=0) for s in (x, y))
        paths = []
        for sketch in (a, b):
            level = {int(p) for p in chosen_path._path(
                np.zeros(trees, np.uint64), np.arange(trees), sketch[:trees])}
            for _ in range(chosen_path.LEVELS - 1):
                above, deeper = np.array(sorted(level), np.uint64), set()
                for k in range(chosen_path.BRANCHES):
                    chosen = chosen_path.mix(above + np.uint64(k + 1)) % np.uint64(chosen_path.SKETCH)
                    deeper |= {int(p) for p in chosen_path._path(above, chosen, sketch[chosen.astype(int)])}
                level = deeper
            paths.append(level)
        met += bool(paths[0] & paths[1])
    assert met / pairs >= 0.97


def test_empty_table(no_docs):
    assert chosen_path.similar_classes(no_docs).collect() == []
