from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus
from codestrata.llm import mixing


def plain_targets(sizes):
    weights = [(3, 1, 2)[n % 3] for n in range(len(sizes))]
    wanted, capped = 1.5 * sum(sizes), set()
    while True:
        left = wanted - sum(2 * sizes[n] for n in capped)
        weight = sum(w for n, w in enumerate(weights) if n not in capped)
        over = {n for n in range(len(sizes)) if n not in capped and left * weights[n] / weight > 2 * sizes[n]}
        if not over:
            return [2.0 * s if n in capped else left * weights[n] / weight for n, s in enumerate(sizes)]
        capped |= over


@pytest.mark.parametrize("block_words", [1, 64, 4096])
def test_targets_and_limits(docs, found, block_words):
    rows = mixing.mix(docs, block_words=block_words).collect()
    assert len(rows) == len(found)
    sizes, taken, target = Counter(), Counter(), {}
    for row in rows:
        sizes[row["source"]] += row["size"]
        taken[row["source"]] += row["taken"]
        target[row["source"]] = row["target"]
        assert 0 <= row["taken"] <= 2 * row["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = plain_targets([sizes[s] for s in order])
    for source, goal in zip(order, wanted):
        assert target[source] == pytest.approx(goal)
        assert taken[source] == int(goal)
    assert Counter(row["size"] for row in rows) == Counter(len(corpus.words(r[1])) for r in found)


def test_reruns_and_partitions_agree(docs):
    once = Counter(map(tuple, mixing.mix(docs).collect()))
    assert once == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_schedule_gives_each_source_its_share_of_every_stretch(spark):
    plan = [(0, "a", 6000, 6000.0, 6000, 60, 1), (1, "b", 3000, 3000.0, 3000, 30, 1)]
    visits = mixing._block_visits(spark, plan, 100).collect()
    assert Counter(row["no"] for row in visits) == {0: 60, 1: 30}
    assert all(row["whole"] == 1 and row["part"] == 0 for row in visits)


def test_mixed_rows(docs, found):
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    times = Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect())
    wanted = defaultdict(int)
    texts = {mixing_key(r): (r[0], r[1], r[3]) for r in found}
    for row in mixing.mix(docs).collect():
        if row["size"]:
            n = int(row["taken"] / row["size"] + 0.5)
            if n:
                wanted[texts[(row["key"], row["source"])]] += n
    assert times == wanted


def mixing_key(row):
    import hashlib

    doc_id = "" if row[0] is None else str(row[0])
    return hashlib.md5(f"{doc_id}:{row[1] or ''}".encode()).hexdigest(), row[3]


def test_empty_tables(spark, no_docs, found):
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed(no_docs).collect() == []
    blank = corpus.table(spark, [(1, " ", *found[0][2:]), (2, None, *found[0][2:])])
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 2
