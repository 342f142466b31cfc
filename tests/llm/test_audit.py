from __future__ import annotations

import math
import re
from collections import Counter
from itertools import permutations

import corpus
from codestrata.llm import audit


def fails(row, found):
    words, text = corpus.words(row[1]), row[1] or ""
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if row[0] is not None and any(o[0] is not None and o[0] < row[0] and (o[1] or "") == text for o in found):
        out.add("E")
    return out


def plain(found, labels):
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, toxic in labels if toxic == 1}
    docs = [(row[3] or "", row[0], fails(row, found)) for row in found]
    rows = Counter()
    for part in {d[0] for d in docs}:
        own, steps, shapley = [d for d in docs if d[0] == part], [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                before = set(order[: step - 1])
                shapley[f] += len(gone)
                steps.append(
                    (part, order, step, len(left), len(gone),
                     sum(f in d[2] and bool(before & d[2]) for d in own),
                     sum(d[2] == {f} for d in own),
                     sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone))
                )
        rows.update((*s, shapley[s[1][s[2] - 1]]) for s in steps)
    return rows


def test_equals_every_order_applied(spark, found):
    rng = __import__("random").Random(5)
    more = [(400 + n, corpus.prose(rng, 260), *found[0][2:]) for n in range(4)]
    more += [(410, more[0][1] + " 5%", *found[1][2:]), (411, more[1][1].title(), *found[1][2:])]
    more += [(412, more[2][1], *found[1][2:]), (413, "a b " * 200, *found[2][2:])]
    more += [(414, "A#", *found[2][2:]), (415, "A#", *found[2][2:])]
    rows = found + more
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 420, 3)] + [(0, None, None), (3, 0, 1)]
    given = spark.createDataFrame([(*x, "s") for x in labels], "doc_id long, quality int, toxic int, source string")
    got = audit.audit(corpus.table(spark, rows), given)
    wanted = plain(rows, labels)
    assert Counter(map(tuple, got.collect())) == wanted
    assert {len(f) for f in (fails(r, rows) for r in rows)} >= {0, 1, 2, 3, 4}


def test_paths_of_the_lattice():
    lattice = audit.Lattice(5)
    assert lattice.reaching[-1] == lattice.leaving[0] == math.factorial(5)
    # Every order uses one edge of each filter.
    assert ((lattice.of_filter @ lattice.orders) == math.factorial(5)).all()
    for edge in range(len(lattice.state)):
        assert (lattice.path == edge).sum() == lattice.orders[edge]


def test_empty_table(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(no_docs, labels).collect() == []
