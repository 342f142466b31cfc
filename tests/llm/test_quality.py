from __future__ import annotations

from collections import Counter

import pytest

import corpus
from codestrata.llm import quality

COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()


def plain(doc_id, text):
    words, text = corpus.words(text), text or ""
    windows = Counter(tuple(words[n : n + 3]) for n in range(len(words) - 2))
    covered = {
        n + k
        for n in range(len(words) - 2)
        for k in range(3)
        if windows[tuple(words[n : n + 3])] > 1
    }
    lines = [line for line in text.split("\n") if corpus.words(line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    chars = sum(map(len, words))
    return (doc_id, len(words), chars, symbols, len(lines) - len(set(lines)), len(covered), failed)


def test_counts_of_every_case(spark, docs, found):
    extra = [(400, "a b c " * 40, *found[0][2:]), (401, "x\nx\n y\nx \n\n\n", *found[0][2:])]
    extra += [(402, "a a a a", *found[0][2:]), (403, "# b c d b c e b c d", *found[0][2:])]
    result = quality.quality(docs.unionByName(corpus.table(spark, extra)))
    got = Counter(tuple(row[c] for c in COLUMNS) for row in result.collect())
    assert got == Counter(plain(row[0], row[1]) for row in [*found, *extra])


def test_verdict_does_not_depend_on_order(spark, docs):
    stats = quality.with_text_stats(docs.select("doc_id", "text"))
    rules = list(quality.RULES)
    forth = stats.select(quality.cascade(rules).alias("kept")).collect()
    back = stats.select(quality.cascade(rules[::-1]).alias("kept")).collect()
    assert forth == back


def test_cascade_orders_by_rejections_per_second(spark, docs):
    stats = quality.with_text_stats(docs.select("doc_id", "text"))
    all_pass, none_pass = quality.Rule("a", "true"), quality.Rule("b", "n_words < 0")
    measured = quality.measure(stats, (all_pass, none_pass))
    assert [m.rejected for m in measured] == [0.0, 1.0]
    assert measured[1].rejections_per_second > measured[0].rejections_per_second == 0


@pytest.mark.parametrize(
    "text",
    [
        "word### " * 30 + " ".join(f"w{n}***" for n in range(60)),
        " ".join(f"W{n}ORD!!" for n in range(80)),
        " ".join(f"cell{n} |" for n in range(60)),
        " ".join(f"{n}{n * 7}" for n in range(1000, 1100)),
    ],
)
def test_junk_goes(spark, found, text):
    result = quality.quality(corpus.table(spark, [(1, text, *found[0][2:])]))
    assert [row["kept"] for row in result.collect()] == [False]


def test_empty_table(no_docs):
    assert quality.quality(no_docs).collect() == []
