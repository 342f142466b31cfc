from __future__ import annotations

from collections import defaultdict

from codestrata.llm import preference

TURNS = "pair_id long, turn long, role string, text string, start string, position string"


def side(spark, turns):
    return spark.createDataFrame([(*t, "s", "p") for t in turns], TURNS)


def plain(chosen, rejected):
    """Sort, compare and render each pair in turn."""
    out = []
    by_side = [defaultdict(list), defaultdict(list)]
    for n, turns in enumerate((chosen, rejected)):
        for pair, *rest in turns:
            if pair is not None:
                by_side[n][pair].append(tuple(rest))
    low = lambda x: (x is not None, x)
    for pair in by_side[0].keys() | by_side[1].keys():
        a, b = (sorted(s[pair], key=lambda t: tuple((x is not None, x or 0 if n == 0 else x or "") for n, x in enumerate(t))) for s in by_side)
        k = 0
        while k < min(len(a), len(b)) and a[k][1:] == b[k][1:]:
            k += 1
        for name, turns in (("chosen", a), ("rejected", b)):
            start = 0
            for n, (_, role, text) in enumerate(turns):
                shown = f"<|{role or ''}|>\n{text or ''}\n<|end|>\n"
                part = "prompt" if n < k else name
                if part != "prompt" or name == "chosen":
                    out.append((pair, part, n, role, shown, n >= k and role == "assistant", start, len(shown)))
                start += len(shown)
    return sorted(out, key=repr)


def test_every_case(spark):
    shared = [(0, "system", "be kind"), (1, "user", "hi"), (2, "assistant", "hello"), (3, "user", "and?")]
    chosen = [(1, *t) for t in shared] + [(1, 4, "assistant", "good"), (1, 5, "user", "thanks")]
    rejected = [(1, *t) for t in shared] + [(1, 4, "assistant", "bad")]
    chosen += [(2, 0, "user", "same"), (2, 1, "assistant", "same")]
    rejected += [(2, 0, "user", "same"), (2, 1, "assistant", "same")]
    chosen += [(3, 0, "user", "only chosen")]
    rejected += [(4, 0, "user", "only rejected")]
    chosen += [(5, 0, None, None), (5, 0, None, None), (5, 1, "user", ""), (None, 0, "user", "x")]
    rejected += [(5, 0, None, None), (5, 1, "user", ""), (5, None, "user", "no turn")]
    chosen += [(6, n, "user", f"turn {n}") for n in range(5000)]
    rejected += [(6, n, "user", f"turn {n}" if n != 3000 else "other") for n in range(5000)]
    got = preference.format_pairs(side(spark, chosen), side(spark, rejected)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(chosen, rejected)


def test_empty_tables(spark):
    assert preference.format_pairs(side(spark, []), side(spark, [])).collect() == []
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_pairs(*preference.neighbours(none)).collect() == []


def test_neighbours(spark):
    turns = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 1, "assistant", "d"), (1, 2, "user", "e"), (2, 0, "user", "f"), (3, 0, "assistant", "g"), (None, 0, "assistant", "h")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chosen, rejected = preference.neighbours(table)
    assert sorted(map(tuple, chosen.collect())) == [t for t in turns if t[0] in (0, 1, 3)]
    assert sorted(map(tuple, rejected.collect())) == [(0, 0, "user", "a"), (0, 1, "assistant", "d"), (1, 0, "user", "c"), (1, 1, "assistant", "b")]
