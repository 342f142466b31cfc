"""What tasks do with the bytes of whole texts, as Column expressions over Arrow batches.

A lambda over the lines or words of a text costs Spark a call for every node of it; these two
look at every line and every word.  Bytes that are not UTF-8 become U+FFFD, as in Java's regexes.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.text import FUNCTION_WORDS

# Tasks get these functions with the query and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# White space beyond ASCII, in UTF-8.
WIDE_SPACES = [
    chr(n).encode()
    for n in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
]
# The same by their first byte, which one search finds.
WIDE_BY_LEAD = {
    lead: [space for space in WIDE_SPACES if space.startswith(lead)]
    for lead in sorted({space[:1] for space in WIDE_SPACES})
}
IDENTIFIER = re.compile(rb"[a-zA-Z_][a-zA-Z0-9_]*")
# A line that may open a block of a brace language.
OPENING = re.compile(
    rb"(?:[ \t\x0b\f\r]|" + b"|".join(WIDE_SPACES) + rb")*+(?:" + FUNCTION_WORDS.encode() + rb") "
)
DEFINES = re.compile(rb"def[ \t\x0b\f\r]++[^\n]")
# Characters that a line starts with which ends no block of an indented language, by byte; one
# without text starts with its end.
ENDS_NOTHING = np.isin(np.arange(256), list(b"#)]}@\n"))
PREVIEW_LINES = 4
# White space within a line, by byte, and the table that makes it spaces.
IS_SPACE = np.isin(np.arange(256), list(b" \t\x0b\f\r"))
AS_SPACE = bytes.maketrans(b"\t\x0b\f\r", b"    ")


def plain_bytes(text: bytes, valid: bool = False) -> bytes:
    """``text`` as UTF-8, with a space for every white space character beyond ASCII.

    A text that is ``valid`` UTF-8 is not decoded.
    """
    if text.isascii():
        return text
    if not valid:
        text = text.decode("utf-8", "replace").encode()
    for lead, spaces in WIDE_BY_LEAD.items():
        if lead in text:
            for space in spaces:
                text = text.replace(space, b" ")
    return text


def all_valid(texts: pa.Array) -> bool:
    """Whether all bytes of ``texts`` are UTF-8."""
    try:
        texts.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


def _cut(lines: list[bytes], mark: bytes) -> list[bytes]:
    """Lines, each cut at its first ``mark`` unless it starts with it."""
    return [line if (at := line.find(mark)) <= 0 else line[:at] for line in lines]


def normal_text(plain: bytes) -> bytes:
    """A text with plain spaces, its lines normalised, with a newline behind each.

    A line is trimmed, cut at its first ``//`` and then at its first ``#`` unless it starts with it,
    and its runs of white space become one space.  The text is looked at as an array of bytes.
    """
    given = np.frombuffer(b"\n%b\n" % plain.translate(AS_SPACE), np.uint8)
    space = given == 32
    kept = np.ones(len(given), bool)
    # Of a run of spaces the first stays, but for one that a line begins with.
    kept[1:] = ~(space[1:] & (space | (given == 10))[:-1])
    normal = given[kept].tobytes().replace(b" \n", b"\n")[1:]
    marks = [mark for mark in (b"//", b"#") if mark in normal]
    if marks:
        lines = normal.split(b"\n")
        for mark in marks:
            lines = _cut(lines, mark)
        # What a cut leaves of a line may end in a space.
        normal = b"\n".join(lines).replace(b" \n", b"\n")
    return normal


def first_shown(body: bytes, most: int) -> list[bytes]:
    """The first ``most`` lines of ``body`` that are not empty."""
    shown = []
    while body and len(shown) < most:
        line, _, body = body.lstrip(b"\n").partition(b"\n")
        shown.append(line)
    return shown[: -1 if shown and not shown[-1] else None]


def lists(sizes: list[int], fields: dict[str, pa.Array]) -> pa.Array:
    """Lists of structs, so many of the ``fields``' rows in each."""
    offsets = [0]
    for size in sizes:
        offsets.append(offsets[-1] + size)
    structs = pa.StructArray.from_arrays(list(fields.values()), list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def brace_spans(text: bytes, min_lines: int) -> list[tuple[int, int]]:
    """Blocks of a brace language as ``(start, n)``, 0-based start line.

    A block opens on a line with a function word and ``{``.  From the next line on it closes
    where the depth is not positive.  What is still open at the end is dropped.  Only lines with
    braces are looked at; a block that its first line left without depth ends on the next one.
    """
    given = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(given == 10)
    n_lines = len(ends) + 1
    ups, downs = (
        np.bincount(np.searchsorted(ends, np.flatnonzero(given == brace)), minlength=n_lines)
        for brace in b"{}"
    )
    spans = []
    start, depth = -1, 0

    def close(n: int) -> None:
        if n - start + 1 >= min_lines:
            spans.append((start, n - start + 1))

    telling = np.flatnonzero(ups + downs)
    begins = np.append(0, ends + 1)[telling].tolist()
    changes = zip(telling.tolist(), begins, ups[telling].tolist(), downs[telling].tolist())
    for n, begin, up, down in changes:
        if start >= 0 and depth <= 0 and n > start + 1:
            close(start + 1)
            start = -1
        if start >= 0:
            depth += up - down
            if depth <= 0:
                close(n)
                start = -1
        elif up and OPENING.match(text, begin):
            start, depth = n, up - down
    if start >= 0 and depth <= 0 and start + 1 < n_lines:
        close(start + 1)
    return spans


def indent_spans(text: bytes, plain: bytes, min_lines: int) -> list[tuple[int, int]]:
    """Blocks of an indented language as ``(start, n)``; ``plain`` is the text with plain spaces.

    A block opens at ``def``.  It ends at a line with text that is indented no deeper than the
    ``def``, unless the line starts with a comment, closing bracket or decorator.  The ending
    line may open the next block.  Blank lines before it belong to the block.
    """
    given = np.frombuffer(plain + b"\n", np.uint8)
    ends = np.flatnonzero(given == 10)
    shown = np.flatnonzero(~IS_SPACE[given])
    # Where each line's text begins; a line without any begins at its end.
    places = shown[np.searchsorted(shown, np.append(0, ends[:-1] + 1))]
    lines = np.flatnonzero(~ENDS_NOTHING[given[places]])
    places = places[lines]
    indents = _indents(text)[lines]
    may_open = np.flatnonzero(given[places] == ord("d"))
    opens = [k for k in may_open.tolist() if DEFINES.match(plain, places[k])]
    ending: dict[int, np.ndarray] = {}
    spans = []
    end = 0
    for k in opens:
        if k < end:
            continue
        depth = int(indents[k])
        if depth not in ending:
            ending[depth] = np.flatnonzero(indents <= depth)
        at = np.searchsorted(ending[depth], k, "right")
        end = int(ending[depth][at]) if at < len(ending[depth]) else len(lines)
        start = int(lines[k])
        n = (int(lines[end]) if end < len(lines) else len(ends)) - start
        if n >= min_lines:
            spans.append((start, n))
    return spans


def _indents(text: bytes) -> np.ndarray:
    """Spaces and tabs that each line begins with."""
    given = np.frombuffer(text + b"\n", np.uint8)
    begins = np.append(0, np.flatnonzero(given == 10)[:-1] + 1)
    others = np.flatnonzero((given != 32) & (given != 9))
    return others[np.searchsorted(others, begins)] - begins


def _blocks(texts: pa.Array, indented: pa.Array, min_lines: int) -> pa.Array:
    sizes: list[int] = []
    starts: list[int] = []
    lengths: list[int] = []
    hashes: list[str] = []
    previews: list[bytes] = []
    valid = all_valid(texts)
    for given, by_indent in zip(texts, indented.to_pylist()):
        text = (given.as_py() or b"").removesuffix(b"\n")
        spaced = plain_bytes(text, valid)
        if by_indent is None:
            spans = []
        elif by_indent:
            spans = indent_spans(text, spaced, min_lines)
        else:
            spans = brace_spans(text, min_lines)
        sizes.append(len(spans))
        normal = normal_text(spaced) if spans else b""
        ends = np.flatnonzero(np.frombuffer(normal, np.uint8) == 10)
        begins = np.append(0, ends + 1)
        for start, n in spans:
            body = normal[begins[start] : ends[start + n - 1]]
            starts.append(start + 1)
            lengths.append(n)
            hashes.append(sha256(body).hexdigest()[:24])
            shown = first_shown(body, PREVIEW_LINES)
            previews.append(b"    " + b"\n    ".join(shown) + b"\n    ...")
    fields = {
        "line": pa.array(starts, pa.int32()),
        "line_count": pa.array(lengths, pa.int32()),
        "hash": pa.array(hashes, pa.string()),
        "preview": pa.array(previews, pa.string()),
    }
    return lists(sizes, fields)


def normal_blocks(text: Column, by_indent: Column, min_lines: int, kind: str) -> Column:
    """Function blocks of a text as an array of type ``kind``, normalised.

    A null text has none, nor has one that is in no language whose blocks are told ``by_indent`` or
    not.
    """

    def blocks(texts: pa.Array, indented: pa.Array) -> pa.Array:
        return _blocks(texts, indented, min_lines)

    return F.arrow_udf(blocks, kind)(text.cast("binary"), by_indent)


def _count(texts: pa.Array) -> pa.Array:
    sizes: list[int] = []
    names: list[bytes] = []
    counts: list[int] = []
    for text in texts:
        found = Counter(IDENTIFIER.findall(text.as_py() or b""))
        ordered = sorted(found)
        sizes.append(len(ordered))
        names += ordered
        counts += map(found.__getitem__, ordered)
    return lists(sizes, {"name": pa.array(names, pa.string()), "n": pa.array(counts, pa.int32())})


def count_identifiers(text: Column) -> Column:
    """Identifiers of a text in order, with their number: ``array<struct<name,n>>``."""

    def count(texts: pa.Array) -> pa.Array:
        return _count(texts)

    counted = F.arrow_udf(count, "array<struct<name:string,n:int>>")(text.cast("binary"))
    return F.when(text.isNotNull(), counted)
