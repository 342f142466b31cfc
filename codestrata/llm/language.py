"""Language identification by a linear-chain conditional random field over words.

Each word has a state, one of the languages.  Its features are its affixes, the two- and
three-byte sequences in it with its borders, and its entry in a lexicon of words seen often enough
in training; all are hashed into one table of weights.  Transitions between the languages of
neighbours are learned too, from training texts into which parts of other texts are spliced, as in
code-switched text.  Forward-backward gives each word's probabilities; a document's language is
the one with the largest share of its words.

Sequences are stretches of up to ``STRETCH`` words, so that many are worked on at once, place by
place; every word of a text is in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.exchange import run_lengths
from codestrata.llm.maxent import held_out
from codestrata.llm.words import STEP_BYTES, Hasher, Powers, Words, mix, ranges, span_hashes, text_runs

STRETCH = 64
# Training texts of each language, about, and rounds over them.
TEXTS_PER_LANGUAGE, ROUNDS = 200, 25
RATE, PENALTY = 0.5, 1e-4
# Share of training stretches whose end is spliced in from another; lexicon words' least count.
SPLICED, LEXICON_LEAST = 0.3, 3
ROWS = 1 << 16
AFFIXES = (2, 3, 4)
NO_LANGUAGE = "und"


@dataclass
class Field:
    """What was learned: languages, feature weights, transition scores, the lexicon."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray


def _row(code: np.ndarray, kind: int) -> np.ndarray:
    return (mix(code + np.uint64(kind << 56)) >> np.uint64(48)).astype(np.int64) % ROWS


def features(words: Words, hashes: np.ndarray, at: np.ndarray, lexicon: np.ndarray):
    """Rows of the weights for the words at places ``at``: ``(rows, number of rows of each)``."""
    starts, ends = words.starts[at], words.ends[at]
    lengths = ends - starts
    # Each word between a border byte before and behind it.
    data = np.concatenate([words.data, np.uint8([0])])
    padded = data[ranges(starts - 1, lengths + 2)].astype(np.uint64)
    stops = np.cumsum(lengths + 2)
    begins = stops - lengths - 2
    padded[begins] = 0
    padded[stops - 1] = 0
    word = np.repeat(np.arange(len(at)), lengths + 2)
    two = padded[:-1] * np.uint64(256) + padded[1:] if len(padded) else padded
    same_two = word[:-1] == word[1:]
    three = two[:-1] * np.uint64(256) + padded[2:] if len(padded) > 1 else two
    same_three = word[:-2] == word[2:]
    found = [_row(two[same_two], 1), _row(three[same_three], 2)]
    owners = [word[:-1][same_two], word[:-2][same_three]]
    powers = Powers(0xA24BAED4963EE407)
    values = data.astype(np.uint64) + np.uint64(1)
    for size in AFFIXES:
        long = np.flatnonzero(lengths >= size)
        for kind, first in ((3, starts[long]), (4, ends[long] - size)):
            code = span_hashes(values, first, first + size, powers)
            found.append(_row(code >> np.uint64(8), kind))
            owners.append(long)
    if len(lexicon) and len(at):
        own = hashes[at]
        place = np.minimum(np.searchsorted(lexicon, own), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[place] == own)
        found.append(_row(own[known] >> np.uint64(8), 5))
        owners.append(known)
    rows, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.bincount(owner, minlength=len(at))


def scores(weights: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's rows, by language."""
    sums = np.zeros((len(rows) + 1, weights.shape[1]))
    np.cumsum(weights[rows], axis=0, out=sums[1:])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def stretches(counts: np.ndarray) -> np.ndarray:
    """Places of the words of each stretch, a row of ``STRETCH`` each; -1 where there is none."""
    first = np.cumsum(counts) - counts
    n = -(-counts // STRETCH)
    text = np.repeat(np.arange(len(counts)), n)
    begin = ranges(np.zeros(len(counts), np.int64), n) * STRETCH
    place = begin[:, None] + np.arange(STRETCH)[None, :]
    return np.where(place < counts[text][:, None], place + first[text][:, None], -1)


def forward_backward(emitted: np.ndarray, places: np.ndarray, transitions: np.ndarray):
    """Each word's probabilities and the expected transitions of all stretches.

    ``emitted`` has a score for each word and language.  Stretches are worked on side by side, one
    place after another, and scaled to sum to one at each.
    """
    n, n_languages = len(places), transitions.shape[0]
    step = np.exp(transitions)
    emitted = np.exp(emitted - emitted.max(axis=1, keepdims=True))
    emitted = np.concatenate([emitted, np.ones((1, n_languages))])
    found = np.zeros((n, STRETCH, n_languages))
    forward = np.zeros((n, STRETCH, n_languages))
    now = np.full((n, n_languages), 1.0 / n_languages)
    for t in range(STRETCH):
        now = (now @ step if t else now) * emitted[places[:, t]]
        now /= now.sum(axis=1, keepdims=True)
        forward[:, t] = now
    behind = np.ones((n, n_languages))
    moves = np.zeros_like(step)
    for t in range(STRETCH - 1, -1, -1):
        there = places[:, t] >= 0
        both = forward[:, t] * behind
        found[:, t] = both / both.sum(axis=1, keepdims=True)
        weighed = emitted[places[:, t]] * behind
        if t:
            pair = forward[:, t - 1] @ step * weighed
            scale = np.where(there, 1 / np.maximum(pair.sum(axis=1), 1e-300), 0)
            moves += step * (forward[:, t - 1].T @ (weighed * scale[:, None]))
            before = weighed @ step.T
            before /= before.sum(axis=1, keepdims=True)
            behind = np.where(there[:, None], before, 1.0)
    inside = places >= 0
    words = np.zeros((len(emitted) - 1, n_languages))
    words[places[inside]] = found[inside]
    return words, moves


def train(texts: pa.Table, languages: list[str]) -> Field:
    """Fit the field to labelled texts ``(text, lang)`` by gradient steps on the log-likelihood."""
    hasher, noise = Hasher(), np.random.default_rng(1)
    number = {language: n for n, language in enumerate(languages)}
    data, owners, hashes, wanted, counts = [], [], [], [], []
    for batch in texts.to_batches():
        labels = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
        for first, last, words in text_runs(batch, "text", lower=True):
            data.append(words)
            owners.append(len(words))
            hashes.append(hasher.words(words))
            wanted.append(np.repeat(labels[first:last], words.counts()))
            counts.append(words.counts())
    all_hashes, wanted = np.concatenate(hashes), np.concatenate(wanted)
    distinct, seen = np.unique(all_hashes, return_counts=True)
    lexicon = distinct[seen >= LEXICON_LEAST]
    which = np.searchsorted(distinct, all_hashes)
    rows, sizes, known, start = [], np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool), 0
    row_owner = []
    for words, own in zip(data, hashes, strict=True):
        new, at = np.unique(which[start : start + len(own)], return_index=True)
        at, new = at[~known[new]], new[~known[new]]
        found, n = features(words, own, at, lexicon)
        rows.append(found)
        row_owner.append(np.repeat(new, n))
        sizes[new], known[new] = n, True
        start += len(own)
    row_owner, rows = np.concatenate(row_owner), np.concatenate(rows)
    order = np.argsort(row_owner, kind="stable")
    row_owner, rows = row_owner[order], rows[order]

    # Stretches of one language, some with the end of another in place of their own.
    places = stretches(np.concatenate(counts))
    places = places[(places >= 0).sum(axis=1) > 1]
    full = np.flatnonzero(places[:, -1] >= 0)
    if len(full) > 1:
        chosen = full[noise.random(len(full)) < SPLICED]
        source = noise.permutation(full)[: len(chosen)]
        cut = noise.integers(1, STRETCH, len(chosen))
        behind = np.arange(STRETCH)[None, :] >= cut[:, None]
        places[chosen] = np.where(behind, places[source].copy(), places[chosen])
    inside = places >= 0
    used = places[inside]
    flat = np.full(places.shape, -1)
    flat[inside] = np.arange(len(used))
    word, label = which[used], wanted[used]
    follows = inside[:, 1:] & inside[:, :-1]
    n_languages = len(languages)
    pairs = label[flat[:, :-1][follows]] * n_languages + label[flat[:, 1:][follows]]
    seen_moves = np.bincount(pairs, minlength=n_languages**2).reshape(n_languages, n_languages)

    weights = np.zeros((ROWS, n_languages))
    transitions = np.zeros((n_languages, n_languages))
    square, square_moves = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    target = np.zeros((len(distinct), n_languages))
    np.add.at(target, (word, label), 1)
    for _ in range(ROUNDS):
        emitted = scores(weights, rows, sizes)
        expected, moves = forward_backward(emitted[word], flat, transitions)
        slope = target.copy()
        for n in range(n_languages):
            slope[:, n] -= np.bincount(word, weights=expected[:, n], minlength=len(distinct))
        by_row = np.stack(
            [np.bincount(rows, weights=slope[row_owner, n], minlength=ROWS) for n in range(n_languages)],
            axis=1,
        ) / len(word) - PENALTY * weights / ROWS
        by_move = (seen_moves - moves) / len(word)
        square += by_row**2
        square_moves += by_move**2
        weights += RATE * by_row / np.sqrt(square)
        transitions += RATE * by_move / np.sqrt(square_moves)
    return Field(languages, weights, transitions, lexicon)


def _has_letter(words: Words, texts: list[str | None]) -> np.ndarray:
    """Whether each text of a run has a letter of any script."""
    letters = np.zeros(256, dtype=bool)
    letters[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    total = np.concatenate([[0], np.cumsum(letters[words.data])])
    found = total[words.offsets[1:]] > total[words.offsets[:-1]]
    for n in np.flatnonzero(~found):
        found[n] = any(c.isalpha() for c in texts[n] or "")
    return found


class Labeller:
    """Labels the texts of one task."""

    def __init__(self, field: Field) -> None:
        self.field, self.hasher = field, Hasher()
        self.names = np.array(field.languages, dtype=object)
        self.letter = np.zeros(256, dtype=bool)
        self.letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

    def __call__(self, words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language and score of each text, and the likeliest language of each word."""
        field, counts, hashes = self.field, words.counts(), self.hasher.words(words)
        which, distinct = pd.factorize(hashes)
        at = np.zeros(len(distinct), np.int64)
        at[which[::-1]] = np.arange(len(which))[::-1]
        emitted = scores(field.weights, *features(words, hashes, at, field.lexicon))
        likely, _ = forward_backward(emitted[which], stretches(counts), field.transitions)
        has = np.concatenate([[0], np.cumsum(self.letter[words.data])])
        spoken = has[words.ends] > has[words.starts]
        sums = np.zeros((len(words) + 1, len(field.languages)))
        np.cumsum(likely * spoken[:, None], axis=0, out=sums[1:])
        shares = sums[words.first[1:]] - sums[words.first[:-1]]
        total = shares.sum(axis=1)
        real = _has_letter(words, texts.to_pylist()) & (total > 0)
        score = np.where(real, shares.max(axis=1) / np.maximum(total, 1e-300), 0.0)
        languages = np.where(real, self.names[shares.argmax(axis=1)], NO_LANGUAGE)
        return languages, np.clip(score, 0.0, 1.0), likely.argmax(axis=1)


def _labelled(field: Field, spans: bool):
    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(field)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            out = batch.column(batch.schema.get_field_index("held_out"))
            for first, last, words in text_runs(batch, "text", lower=True, limit=STEP_BYTES):
                languages, score, best = label(words, texts.slice(first, last - first))
                columns = [
                    ids.slice(first, last - first),
                    out.slice(first, last - first),
                    pa.array(languages, pa.string()),
                    pa.array(score),
                ]
                labels = ["doc_id", "held_out", "lang_pred", "score"]
                if spans:
                    columns.append(_spans(words, best, label.names))
                    labels.append("spans")
                yield pa.RecordBatch.from_arrays(columns, labels)

    return labelled


def _spans(words: Words, label: np.ndarray, names: np.ndarray) -> pa.Array:
    """Runs of words of one language: ``(first word, number of words, language)``."""
    text = words.text_of()
    starts, lengths = run_lengths(text * (len(names) + 1) + label)
    owner = text[starts]
    offsets = np.searchsorted(owner, np.arange(len(words.offsets)))
    values = pa.StructArray.from_arrays(
        [
            pa.array(starts - words.first[owner], pa.int64()),
            pa.array(lengths, pa.int64()),
            pa.array(names[label[starts]], pa.string()),
        ],
        ["first_word", "n_words", "lang"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def fit(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> Field:
    """Fit a field to a bounded sample of ``(doc_id, text, lang)``, leaving out held-out ids.

    The sample has about ``TEXTS_PER_LANGUAGE`` whole texts of each language.
    """
    training = docs.filter(~held_out(F.col("doc_id"), modulus, remainder)).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    totals = {row["lang"]: row["n"] for row in training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return Field([], np.zeros((ROWS, 0)), np.zeros((0, 0)), np.zeros(0, np.uint64))
    fractions = {lang: min(1.0, TEXTS_PER_LANGUAGE / n) for lang, n in totals.items()}
    languages = sorted(totals)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        field = train(table.sort_by([("lang", "ascending"), ("text", "ascending")]), languages)
        blobs = [
            field.weights.astype(np.float32).tobytes(),
            field.transitions.tobytes(),
            field.lexicon.tobytes(),
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1, 2], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"]
        )

    sample = training.sampleBy("lang", fractions, 1).select("text", "lang").repartition(1)
    parts = {row["part"]: row["blob"] for row in sample.mapInArrow(fitted, "part int, blob binary").collect()}
    n = len(languages)
    return Field(
        languages,
        np.frombuffer(parts[0], np.float32).reshape(ROWS, n),
        np.frombuffer(parts[1], np.float64).reshape(n, n),
        np.frombuffer(parts[2], np.uint64),
    )


def identify(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    modulus: int = 4,
    remainder: int = 2,
    spans: bool = False,
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of each document, with ``spans`` also its runs of words.

    ``score`` is the language's share of the words.  A text that is null or has no letter is
    ``und`` with score 0, as is every text when there is nothing to learn from.  A null id is
    neither learned from nor held out; repeated rows are judged each; other columns are left out;
    an empty table gives no rows.
    """
    key = docs[id_column].cast("long")
    texts = docs.select(
        key.alias("doc_id"),
        docs[text_column].alias("text"),
        docs[lang_column].alias("lang"),
        F.coalesce(held_out(key, modulus, remainder), F.lit(False)).alias("held_out"),
    )
    field = fit(texts, modulus, remainder)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    if spans:
        schema += ", spans array<struct<first_word: long, n_words: long, lang: string>>"
    chosen = texts.select("doc_id", "text", "held_out")
    if not field.languages:
        nothing = chosen.select("doc_id", "held_out", F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))
        if spans:
            kind = "array<struct<first_word: long, n_words: long, lang: string>>"
            nothing = nothing.withColumn("spans", F.array().cast(kind))
        return nothing
    return chosen.mapInArrow(_labelled(field, spans), schema)


def keep_identified(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    modulus: int = 4,
    remainder: int = 2,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language.

    Texts that `identify` finds to be ``und`` go: null ones and those without a letter.  A text in
    several languages stays, whatever their shares.  Without a labelled row to learn from there is
    nothing to judge by, and all rows stay.  Rows that share an id are judged one by one; texts of
    any length are read whole; an empty table gives no rows.
    """
    field = fit(
        docs.select(
            docs[id_column].cast("long").alias("doc_id"),
            docs[text_column].alias("text"),
            docs[lang_column].alias("lang"),
        ),
        modulus,
        remainder,
    )
    if not field.languages:
        return docs
    # Rows with their texts go to the tasks once; the text is read out of the row.
    carried = docs.select(F.struct("*").alias("row"))
    place = docs.columns.index(docs.select(docs[text_column]).columns[0])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(field)
        for batch in batches:
            rows = batch.column(0)
            texts = rows.field(place)
            alone = pa.RecordBatch.from_arrays([texts], ["text"])
            for first, last, words in text_runs(alone, "text", lower=True, limit=STEP_BYTES):
                languages, _, _ = label(words, texts.slice(first, last - first))
                keep = pa.array(languages != NO_LANGUAGE)
                own = rows.slice(first, last - first).filter(keep)
                yield pa.RecordBatch.from_arrays([own], ["row"])

    return carried.mapInArrow(kept, carried.schema).select("row.*")
