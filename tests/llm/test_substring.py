from __future__ import annotations

from collections import Counter

import pytest

import corpus
from codestrata.llm import substring


def plain(found, width=35):
    texts = [corpus.words(row[1]) for row in found]
    starts = Counter(
        tuple(words[n : n + width]) for words in texts for n in range(len(words) - width + 1)
    )
    out = []
    for row, words in zip(found, texts):
        gone = {
            n + k
            for n in range(len(words) - width + 1)
            if starts[tuple(words[n : n + width])] > 1
            for k in range(width)
        }
        left = " ".join(word for n, word in enumerate(words) if n not in gone)
        out.append((row[0], left, len(words), len(gone)))
    return out


def test_equals_all_windows(docs, found):
    got = Counter(map(tuple, substring.remove_repeats(docs).collect()))
    assert got == Counter(plain(found))


def test_repeats_within_one_text_and_passages_of_just_the_width(spark, found):
    passage = [f"p{n}" for n in range(35)]
    rest = found[0][2:]
    rows = [
        (1, " ".join(passage + ["a"] + passage), *rest),
        (2, " ".join(["b"] * 90), *rest),
        (3, " ".join(f"q{n}" for n in range(34)), *rest),
        (4, " ".join(f"q{n}" for n in range(34)), *rest),
    ]
    for shift in range(23):  # every offset of the passage against the cover
        rows.append((10 + shift, " ".join([f"r{shift}x{n}" for n in range(shift)] + passage[:-1] + [f"z{shift % 5}"]), *rest))
    got = Counter(map(tuple, substring.remove_repeats(corpus.table(spark, rows)).collect()))
    assert got == Counter(plain(rows))


def test_rows_keep_their_columns_and_untouched_texts(docs, found):
    got = substring.replace_texts(docs)
    assert got.columns == docs.columns
    wanted = Counter()
    for row, (_, left, _, removed) in zip(found, plain(found)):
        wanted[(row[0], left if removed else row[1] or "", row[2])] += 1
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in got.collect()) == wanted


@pytest.mark.parametrize("period, cover", [(21, substring.COVER), (13, (0, 1, 3, 9)), (7, (0, 1, 3))])
def test_cover(period, cover):
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_empty_table(no_docs):
    assert substring.remove_repeats(no_docs).collect() == []
