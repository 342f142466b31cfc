from __future__ import annotations

from collections import Counter

import corpus
import corpus_pipeline
import test_jaccard
import test_mixing
import test_substring


def test_stages_follow_each_other(spark, docs, found, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    results = [read]
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, results[-1], str(tmp_path)).write.parquet(out)
        results.append(spark.read.parquet(out))
    columns = [sorted(r.columns) for r in results[:-1]]
    assert all(c == columns[0] for c in columns)
    identified, different, shorter, mixed, packed = ([tuple(r[c] for c in docs.columns) for r in x.collect()] if n < 4 else x.collect() for n, x in enumerate(results[1:]))
    clean = {f[0] for f in found if f[0] is not None and f[0] < 40}
    assert clean <= {r[0] for r in identified} and 304 not in {r[0] for r in identified}
    _, sets, group = test_jaccard.plain(identified)
    assert len(different) == len({g for g, s in zip(group, sets) if s}) + sum(not s for s in sets)
    wanted = Counter((r[0], left if gone else r[1]) for r, (_, left, _, gone) in zip(different, test_substring.plain(different)))
    assert Counter((r[0], r[1]) for r in shorter) == wanted
    assert all(r[4] == len(r[1]) for r in shorter)
    assert {(r[0], r[1]) for r in mixed} <= {(r[0], r[1]) for r in shorter}
    assert max(Counter((r[0], r[1]) for r in mixed).values()) <= 2
    # A source's mix is off by the half of one document at most.
    sizes, taken = Counter(), Counter()
    for counter, rows in ((sizes, shorter), (taken, mixed)):
        for r in rows:
            counter[r[3]] += len(corpus.words(r[1]))
    order = sorted(sizes, key=lambda source: (source is None, source or ""))
    for source, target in zip(order, test_mixing.plain_targets([sizes[x] for x in order])):
        largest = max(len(corpus.words(r[1])) for r in shorter if r[3] == source)
        assert abs(taken[source] - target) <= largest / 2 + 1
    assert {p["doc_id"] for p in packed} == {r[0] for r in mixed}


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    fill = rows.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert fill.max() <= 2048 and len(fill) > 0
