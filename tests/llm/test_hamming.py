from __future__ import annotations

import math

import numpy as np
import pytest

from codestrata.llm import hamming

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "v", "b") for i, v in rows], SCHEMA)


def exact(rows, every, nearest=5):
    clean = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in sorted(i for i in clean if i % every == 0):
        scores = [(-float(clean[q] @ v / np.linalg.norm(clean[q]) / np.linalg.norm(v)), i) for i, v in clean.items() if i != q]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scores)[:nearest]]
    return out


def clustered(n, dims=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dims))
    points = centres[rng.integers(0, 20, n)] + 0.6 * rng.standard_normal((n, dims))
    return [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]


def found(frame):
    got = {}
    for row in frame.orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    return got


def test_recall_and_scores(spark):
    rows = clustered(1500)
    got, wanted = found(hamming.nearest_vectors(table(spark, rows), every=20)), exact(rows, 20)
    assert got.keys() == wanted.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 5 * len(wanted)
    vectors = {i: np.array(v) for i, v in rows}
    for q, near in got.items():
        assert len(near) == 5 and [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        for i, score in near:
            a, b = vectors[q], vectors[i]
            assert score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_recall_with_a_sample_of_a_tenth(spark, monkeypatch):
    rows = clustered(4000)
    monkeypatch.setattr(hamming, "SAMPLE_VECTORS", 400)
    fitted = []
    fit = hamming.fit_codes
    monkeypatch.setattr(hamming, "fit_codes", lambda sample, nearest: fitted.append((len(sample), fit(sample, nearest))) or fitted[-1][1])
    # Blocks of 512 vectors, so that a query meets several.
    monkeypatch.setattr(hamming, "BLOCK_BYTES", 8 * 32 * 512)
    got, wanted = found(hamming.nearest_vectors(table(spark, rows))), exact(rows, 50)
    (size, codes), = fitted
    assert 300 <= size <= 400
    assert got.keys() == wanted.keys() and all(len(near) == 5 for near in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * 5 * len(wanted)
    packed = codes(np.array([v for _, v in rows]))
    index, masks = hamming.Index(packed), hamming.near_values(codes.reach)
    compared = [len(index.within(packed[q], index.probe(packed[q], masks), codes.limit)) for q in wanted]
    assert np.mean(compared) < 0.1 * len(rows)


def test_every_code_within_the_radius_is_found():
    vectors = np.array([v for _, v in clustered(400)])
    codes = hamming.fit_codes(vectors)
    packed = codes(vectors)
    index = hamming.Index(packed)
    for reach in range(5):
        codes.reach = reach
        masks = hamming.near_values(reach)
        assert codes.radius == 16 * (reach + 1) - 1
        for q in range(0, 400, 50):
            apart = np.unpackbits(packed ^ packed[q], axis=1).sum(axis=1)
            probed = set(index.probe(packed[q], masks).tolist())
            assert set(np.flatnonzero(apart <= codes.radius).tolist()) <= probed
            near = index.within(packed[q], index.probe(packed[q], masks), codes.radius)
            assert near.tolist() == np.flatnonzero(apart <= codes.radius).tolist()


def test_awkward_vectors_copies_and_ties(spark):
    rows = clustered(40, 8)
    rows += [(100 + n, rows[0][1]) for n in range(30)]
    rows += [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [1.0] * 6), (203, [math.nan] * 8), (204, [math.inf] + [1.0] * 7), (None, [1.0] * 8), (250, [])]
    got = found(hamming.nearest_vectors(table(spark, rows), every=50))
    wanted = exact(rows, 50)
    assert got.keys() == wanted.keys()
    for q in wanted:
        if q in (0, 100):  # copies of one vector: the least ids come first
            assert [i for i, _ in got[q]] == [i for i, _ in wanted[q]]


def test_each_length_has_its_own_neighbours(spark):
    wide, narrow = clustered(60, 8), [(1000 + n, v) for n, (_, v) in enumerate(clustered(45, 3))]
    alone = [(2000, [1.0, 2.0])]
    got = found(hamming.nearest_vectors(table(spark, wide + narrow + alone), every=10))
    wanted = exact(wide, 10) | exact(narrow, 10)
    assert got.keys() == wanted.keys()
    for q, near in got.items():
        assert len(near) == 5 and {i < 1000 for i, _ in near} == {q < 1000}


def test_rows_that_share_an_id_are_rows_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1])]
    got = hamming.nearest_vectors(table(spark, rows)).orderBy("query_id", "rank", "vec_id").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 1, 1), (0, 2, 1), (0, 2, 1), (0, 3, 0), (0, 3, 0)]
    assert sorted(r["score"] for r in got)[:2] == [0.0, 0.0]


def test_very_large_and_small_components(spark):
    rows = [(0, [3e38, 1e38]), (1, [3e-38, 1e-38]), (2, [1e-38, 3e-38])]
    got = found(hamming.nearest_vectors(table(spark, rows)))
    assert [i for i, _ in got[0]] == [1, 2]
    assert got[0][0][1] == pytest.approx(1, abs=1e-7)


def test_few_and_no_vectors(spark):
    assert hamming.nearest_vectors(table(spark, [])).collect() == []
    assert hamming.nearest_vectors(table(spark, [(0, [1.0, 2.0])])).collect() == []
    got = found(hamming.nearest_vectors(table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])])))
    assert [i for i, _ in got[0]] == [2, 2, 1]
