from __future__ import annotations

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus
from codestrata.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_round_trip(docs, found, tokenizer):
    rows = packing.pack(docs).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for row in rows:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert len(ids) == row["length"]
        by_sequence[row["sequence_id"]].append((row["offset"], row["length"]))
        by_doc[(row["doc_id"], row["doc_tokens"])].append((row["start"], ids))
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    for row in found:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1]
        pieces = by_doc[(row[0], len(ids))]
        joined = defaultdict(list)
        for start, part in pieces:
            joined[start].append(part)
        place = 0
        while place < len(ids):
            part = next(p for p in joined[place] if p == ids[place : place + len(p)])
            place += len(part)
        assert place == len(ids)
    total = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in found)
    assert sum(row["length"] for row in rows) == total


def test_classes_have_their_fixed_number_of_pieces():
    bins = packing.Bins(2048, 0)
    done = [p for n in range(33) for p in bins.add((n, 0, 120, b"", 120))]
    assert len(done) == 17 and {p[-2] for p in done} == {0} and 2048 // 120 == 17
    left = list(bins.rest())
    assert [p[-1] for p in left] == [120 * n for n in range(16)]


def test_little_padding(spark, found):
    rng = __import__("random").Random(1)
    rows = [(n, corpus.prose(rng, rng.randint(1, 400)), *found[0][2:]) for n in range(400)]
    pieces = packing.pack(corpus.table(spark, rows).coalesce(1)).toPandas()
    fill = pieces.groupby("sequence_id")["length"].sum()
    assert 1 - fill.sum() / (2048 * len(fill)) < 0.02


def test_parts_are_encoded_as_in_the_whole_text(tokenizer):
    import pyarrow as pa

    from codestrata.llm.words import text_bytes

    texts = ["a  b  \n c\x1c d\x85 e é é　 f ß ç", "  x", "x  ", "\n\n", "it's  'll 12 34!!", "",
             "x  y", "  z 　\n", "<|endoftext|> a", "a <|endoftext|> b<|endoftext|><|endoftext|>", "a  <|endoftext|>  c <|endof", "text|> d",
             "é<|endoftext|>é  ", "<|endoftext|", "<|endoftext|>", "ünïcödé  wörds  here\n\n\n.", "😀 😀😀"]
    encode = packing.Encoder(packing.public_vocabulary())
    for _ in range(2):  # the second time from what is kept
        ids, places = encode(*text_bytes(pa.array(texts)))
        for n, text in enumerate(texts):
            wanted = tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[places[n] : places[n + 1]].tolist() == wanted


def test_empty_table(no_docs):
    assert packing.pack(no_docs).collect() == []
