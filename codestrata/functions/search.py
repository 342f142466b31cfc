"""Searches in the bytes of whole texts, as Column expressions over Arrow batches.

A search goes from one place that may begin a match to the next, so that a text costs little but
where something is found.  Bytes that are not UTF-8 are characters that no pattern holds.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.arrow import IS_SPACE, WIDE_SPACES, lists

# Tasks get these functions with the query and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters beyond ASCII that Java's ``(?iu)`` takes for a letter of ASCII, in UTF-8.
FOLDED = {
    letter: [char.encode() for char in wide]
    for letter, wide in {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}.items()
}
ALL_FOLDED = [char for wide in FOLDED.values() for char in wide]
BLANKS = b"(?:[ \t\x0b\f\r]|" + b"|".join(WIDE_SPACES) + b")*+"
_BLANK, _WORD = rb"[\t\f\r ]", rb"[A-Za-z0-9_]"
SHOWN = re.compile(BLANKS + rb"[^\n]")
# How an over-long function opens, from the start of its line, with its name as the group; and
# what a line with one holds.
OPENINGS = {
    "Go": (re.compile(BLANKS + rb"func" + _BLANK + b"++(" + _WORD + b"++)"), (b"func",)),
    "Python": (re.compile(BLANKS + rb"def" + _BLANK + b"++(" + _WORD + b"++)"), (b"def",)),
    "Java": (
        re.compile(
            rb".*?(?<!" + _WORD + rb")(?:public|private|protected|static)(?!" + _WORD + rb").*"
            + _WORD + _BLANK + rb"+(" + _WORD + rb"+)" + _BLANK + rb"*\("
        ),
        (b"public", b"private", b"protected", b"static"),
    ),
}


def escaped(chars: list[bytes]) -> str:
    """Further alternatives of a pattern of bytes."""
    return "".join("|" + "".join(f"\\x{byte:02x}" for byte in char) for char in chars)


def any_case(word: str) -> str:
    """A pattern of bytes for letters under Java's ``(?iu)``."""
    return "".join(
        f"(?:[{char}{char.upper()}]{escaped(FOLDED.get(char, []))})" for char in word
    )


class Search(NamedTuple):
    """What a rule looks for.

    Every match begins at one of ``literals``; those are lower-cased where ``folds`` says that case
    does not count, and a text with ``ALL_FOLDED`` is then searched at every place.  Without
    literals every place is searched.
    """

    number: int
    languages: tuple[str, ...] | None
    pattern: re.Pattern
    literals: tuple[bytes, ...]
    folds: bool


def places_of(text: bytes, literal: bytes) -> Iterator[int]:
    at = text.find(literal)
    while at >= 0:
        yield at
        at = text.find(literal, at + 1)


def starts_of(text: bytes, lowered: bytes, wide: bool, search: Search) -> list[int]:
    """Where the matches of a search begin that do not overlap, in order."""
    if wide and search.folds or not search.literals:
        return [match.start() for match in search.pattern.finditer(text)]
    held = lowered if search.folds else text
    places = [place for literal in search.literals for place in places_of(held, literal)]
    starts, end = [], 0
    for place in sorted(set(places)):
        match = search.pattern.match(text, place) if place >= end else None
        if match:
            starts.append(place)
            end = match.end()
    return starts


def lines_of(text: bytes, starts: list[int]) -> list[int]:
    """Line numbers of places in a text, which are in order."""
    found, line, before = [], 1, 0
    for start in starts:
        line += text.count(b"\n", before, start)
        before = start
        found.append(line)
    return found


def _hits(texts: pa.Array, langs: pa.Array, searches: tuple[Search, ...]) -> pa.Array:
    sizes: list[int] = []
    numbers: list[int] = []
    counts: list[int] = []
    lines: list[int] = []
    folds = any(search.folds for search in searches)
    for given, lang in zip(texts, langs.to_pylist()):
        text = given.as_py() or b""
        lowered = text.lower() if folds else text
        wide = folds and not text.isascii() and any(map(text.__contains__, ALL_FOLDED))
        n = len(numbers)
        for search in searches:
            if search.languages is None or lang in search.languages:
                found = lines_of(text, starts_of(text, lowered, wide, search))
                if found:
                    numbers.append(search.number)
                    counts.append(len(found))
                    lines += found
        sizes.append(len(numbers) - n)
    offsets = np.append(0, np.cumsum(counts, dtype=np.int64)).astype(np.int32)
    held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(lines, pa.int32()))
    return lists(sizes, {"rule_no": pa.array(numbers, pa.int32()), "lines": held})


def found_hits(text: Column, lang: Column, searches: tuple[Search, ...]) -> Column:
    """Searches with a match, and the lines of all matches: ``array<struct<rule_no,lines>>``."""

    def hits(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return _hits(texts, langs, searches)

    kind = "array<struct<rule_no:int,lines:array<int>>>"
    return F.arrow_udf(hits, kind)(text.cast("binary"), lang)


def _head(text: bytes, words: tuple[bytes, ...], list_end: re.Pattern | None) -> bytes | None:
    last = max(text.rfind(word) + len(word) if word in text else 0 for word in words)
    if not last:
        return None
    if list_end:
        end = list_end.search(text, last)
        return text[: end.end()] if end else text
    end = text.find(b"\n", last)
    return text if end < 0 else text[:end]


def head_to_last(
    text: Column, words: tuple[bytes, ...], list_end: bytes | None = None
) -> Column:
    """A text up to the end of the line that holds the last of ``words``; null without any.

    With ``list_end``, a pattern, it goes on to its first match behind that word, or to the end.
    """
    pattern = re.compile(list_end) if list_end else None

    def heads(texts: pa.Array) -> pa.Array:
        found = (_head(given.as_py() or b"", words, pattern) for given in texts)
        return pa.array(list(found), pa.binary())

    return F.arrow_udf(heads, "binary")(text.cast("binary")).cast("string")


def _opening_lines(
    text: bytes, begins: np.ndarray, pattern: re.Pattern, words: tuple[bytes, ...]
) -> list[int]:
    """Lines that open a function; only lines that hold one of ``words`` are looked at."""
    places = np.array([place for word in words for place in places_of(text, word)], np.int64)
    lines = np.unique(np.searchsorted(begins, places, "right") - 1)
    return [n for n, at in zip(lines.tolist(), begins[lines].tolist()) if pattern.match(text, at)]


def _first_long_by_brace(given: np.ndarray, ends: np.ndarray, opening: list[int], most: int):
    """First function over ``most`` lines as ``(start, n)``, lines from 0, or None.

    From the line behind its first on, a function ends where the depth is not positive.  The line
    that closes one opens none.  Only lines that open one, those behind them and those with braces
    can change this.
    """
    n_lines = len(ends) + 1
    ups, downs = (
        np.bincount(np.searchsorted(ends, np.flatnonzero(given == brace)), minlength=n_lines)
        for brace in b"{}"
    )
    opens = np.zeros(n_lines + 1, bool)
    opens[opening] = True
    behind = np.zeros(n_lines + 1, bool)
    behind[1:] = opens[:-1]
    telling = np.flatnonzero((ups + downs > 0) | opens[:-1] | behind[:-1])
    start, depth = -1, 0
    delta = (ups - downs)[telling].tolist()
    for n, change, opened in zip(telling.tolist(), delta, opens[telling].tolist()):
        if start >= 0:
            depth += change
            if depth <= 0:
                if n - start > most:
                    return start, n - start
                start = -1
        elif opened:
            start, depth = n, change
    return None


def _first_long_by_margin(
    text: bytes, given: np.ndarray, begins: np.ndarray, opening: list[int], most: int
):
    """The same where a function ends at text at the margin, from its third line on."""
    ended = np.append(given, np.uint8(10))[begins]
    inside = (ended == 10) | (ended == 32) | (ended == 9)
    odd = np.flatnonzero(~inside & (IS_SPACE[ended] | (ended > 127)))
    blank = [n for n, at in zip(odd.tolist(), begins[odd].tolist()) if not SHOWN.match(text, at)]
    inside[blank] = True
    margin = np.flatnonzero(~inside)
    end = -1
    for start in opening:
        if start > end:
            at = np.searchsorted(margin, start + 2)
            if at == len(margin):
                return None
            end = int(margin[at])
            if end - start > most:
                return start, end - start
    return None


def _long(texts: pa.Array, langs: pa.Array, most: int) -> pa.Array:
    sizes: list[int] = []
    lines: list[int] = []
    lengths: list[int] = []
    names: list[str] = []
    for given, lang in zip(texts, langs.to_pylist()):
        found = None
        pattern, words = OPENINGS.get(lang, (None, ()))
        text = (given.as_py() or b"").removesuffix(b"\n") if pattern else b""
        # A function over the limit needs more lines than the limit.
        if pattern and text.count(b"\n") > most:
            array = np.frombuffer(text, np.uint8)
            ends = np.flatnonzero(array == 10)
            begins = np.append(0, ends + 1)
            opening = _opening_lines(text, begins, pattern, words)
            if lang == "Python":
                found = _first_long_by_margin(text, array, begins, opening, most)
            elif opening:
                found = _first_long_by_brace(array, ends, opening, most)
        sizes.append(1 if found else 0)
        if found:
            lines.append(found[0] + 1)
            lengths.append(found[1])
            names.append(pattern.match(text, begins[found[0]])[1].decode())
    fields = {
        "line": pa.array(lines, pa.int32()),
        "length": pa.array(lengths, pa.int32()),
        "name": pa.array(names, pa.string()),
    }
    return lists(sizes, fields)


def long_functions(text: Column, lang: Column, max_lines: int) -> Column:
    """``array<struct<line,length,name>>`` with the first function over the limit, or empty."""

    def long(texts: pa.Array, langs: pa.Array) -> pa.Array:
        return _long(texts, langs, max_lines)

    kind = "array<struct<line:int,length:int,name:string>>"
    return F.arrow_udf(long, kind)(text.cast("binary"), lang)
