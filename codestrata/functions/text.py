"""Text functions over whole files and single lines, as Column expressions.

Patterns are written for Java so that they give what RE2 gives: ``\\s`` is spelled out, ``\\b``
becomes a look-around on ASCII word characters, and ``(?md)`` lets only a newline end a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# RE2's \s, with and without the newline.
RE_SPACE = r"[\t\n\f\r ]"
RE_BLANK = r"[\t\f\r ]"
WORD = "[A-Za-z0-9_]"
# RE2's \b before a word character, and after one.
WORD_START = f"(?<!{WORD})"
WORD_END = f"(?!{WORD})"

# Unicode white space apart from the newline, as members of a character class.
_SPACES = (
    r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE = f"[{_SPACES}]"
# White space at the start of a line; most of it is found without the large class.
INDENT = rf"[ \t]*+{SPACE}*+"
NON_SPACE = f"[^{_SPACES}\\n]"
SPACE_CHARACTERS = "\t\n\x0b\f\r " + "".join(
    map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Control characters that mark places in a text; texts are cleared of them before.
MARK, MARK_2, MARK_3, NO_MARK = map(chr, (1, 2, 3, 4))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A column of an earlier ``select`` gives no such promise: the optimizer may copy its
    expression to every place of use, also into lambdas that run once per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_space(value: Column) -> Column:
    return F.btrim(value, F.lit(SPACE_CHARACTERS))


def clear_marks(text: Column) -> Column:
    """Replace the mark characters; a text without any is passed on as it is."""
    marked = F.contains(text, F.lit(MARK))
    for mark in (MARK_2, MARK_3):
        marked = marked | F.contains(text, F.lit(mark))
    cleared = F.translate(text, MARK + MARK_2 + MARK_3, NO_MARK * 3)
    return F.when(marked, cleared).otherwise(text)


def count_of(value: Column, char: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(char), F.lit("")))


def text_prefix(text: Column, n: int) -> Column:
    """First ``n`` bytes of a text; a character cut in half becomes U+FFFD."""
    cut = F.make_valid_utf8(F.substring(F.to_binary(text, F.lit("utf-8")), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(cut)


def scanned_text(text: Column) -> Column:
    """What a line scanner sees of a text: lines joined by newlines, without a final newline.

    One carriage return before each line end is dropped.
    """
    whole = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(
        F.contains(text, F.lit("\r")), F.regexp_replace(whole, r"\r(?=\n|\z)", "")
    ).otherwise(whole)


def lines(text: Column) -> Column:
    """Lines of a text as an array, of any length; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(scanned_text(text), "\n", -1)
    )


# Items of a page of a fold.
PAGE = 256


def found_in_order(
    items: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    kind: str,
    rest: Callable[[Column], Column] | None = None,
) -> Column:
    """What a pass over ``items`` finds, as an array, in time that grows with their number.

    ``step(state, item)`` gives the next state, a struct whose field ``found`` is what the item
    completes, of type ``kind``, or null.  ``rest(state)`` is an array of what the last state adds.

    A fold copies its state at every step, so a list in it would cost its length each time.  The
    first pass holds the state alone and notes it at the head of every page of items; then each page
    is folded by itself from the state noted for it, with a list no longer than the page.
    """
    none = F.array().cast(f"array<{kind}>")
    none_left = F.array().cast("array<int>")

    def of_items(items: Column, n: Column) -> Column:
        last_page = F.floor((n - 1) / PAGE).cast("int")

        def places(page: Column) -> Column:
            return F.sequence(page * PAGE, F.least((page + 1) * PAGE, n) - 1)

        def state_behind(state: Column, page: Column) -> Column:
            return F.aggregate(places(page), state, lambda s, k: step(s, F.get(items, k)))

        heads = F.aggregate(
            F.when(last_page > 0, F.sequence(F.lit(0), last_page - 1)).otherwise(none_left),
            F.array(start),
            lambda states, page: F.concat(
                states, F.array(state_behind(F.element_at(states, -1), page))
            ),
        )

        def with_item(held: Column, k: Column) -> Column:
            return let(
                step(held.state, F.get(items, k)),
                lambda state: F.struct(
                    state.alias("state"),
                    F.when(state.found.isNull(), held.out)
                    .otherwise(F.concat(held.out, F.array(state.found)))
                    .alias("out"),
                ),
            )

        pages = F.transform(
            heads,
            lambda state, page: F.aggregate(
                places(page), F.struct(state.alias("state"), none.alias("out")), with_item
            ),
        )

        def joined(pages: Column) -> Column:
            found = F.flatten(F.transform(pages, lambda page: page.out))
            return F.concat(found, rest(F.element_at(pages, -1).state)) if rest else found

        return let(pages, joined) if rest else joined(pages)

    def of_some(items: Column) -> Column:
        return let(F.size(items), lambda n: F.when(n > 0, of_items(items, n)).otherwise(none))

    return let(items, of_some)


def _with_space_for(char: str, text: Column) -> Column:
    # A search that finds nothing is several times as quick as a replacement that does.
    held = F.contains(text, F.lit(char))
    return F.when(held, F.replace(text, F.lit(char), F.lit(" "))).otherwise(text)


def wide_spaces_plain(text: Column) -> Column:
    """``text`` with a space for every white space character beyond ASCII."""
    # One range around the white space beyond ASCII is quicker to search for than its members.
    may_hold = (F.octet_length(text) > F.length(text)) & text.rlike(
        r"[\x{85}\x{A0}\x{1680}-\x{3000}]"
    )
    wide = SPACE_CHARACTERS[6:]
    return F.when(may_hold, F.translate(text, wide, " " * len(wide))).otherwise(text)


def plain_spaces(text: Column) -> Column:
    """``text`` with a space for every other white space character but the newline."""
    replaced = (partial(_with_space_for, char) for char in "\t\x0b\f\r")
    return reduce(let, replaced, wide_spaces_plain(text))


# What normalising drops from a text whose white space is ASCII, apart from the groups: a line that
# starts with ``//`` up to a ``#`` and one that starts with ``#`` up to ``//`` stay, any other goes
# from the first of the marks on; of a run of white space stays the space it starts with.
_BLANK = r"[ \t\x0B\f\r]"
_DROPPED = (
    rf"(?md)(?=[ \t\x0B\f\r/#])(?:^{_BLANK}*+(//[^#\n]*+)(?:#.*)?$|^{_BLANK}*+(#.*?)(?://.*)?$"
    rf"|{_BLANK}*+(?://|#).*$|^{_BLANK}++|{_BLANK}++$|( ){_BLANK}++)"
)


def normalized_lines(scanned: Column) -> Column:
    """Lines of a scanned text, each normalised.

    Each line is trimmed, cut at its first ``//`` and then at its first ``#`` unless the line
    starts with it, and its runs of white space become one space.  One regex does this but for
    white space inside comments that stay and runs that do not start with a space.
    """

    def rest(text: Column) -> Column:
        untidy = text.rlike(r"[\t\x0B\f\r]|  | \n| \z")
        single = F.regexp_replace(plain_spaces(text), " {2,}", " ")
        return F.when(untidy, F.regexp_replace(single, r"(?md) $", "")).otherwise(text)

    kept = F.regexp_replace(wide_spaces_plain(scanned), _DROPPED, "$1$2$3")
    return F.split(let(kept, rest), "\n", -1)


def normalize_text(scanned: Column) -> Column:
    """The normalised lines of a scanned text as one text."""
    return F.array_join(normalized_lines(scanned), "\n")


def normalize_line(line: Column) -> Column:
    return normalize_text(trim_space(line))


def leading_whitespace(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))


def block_hash(normalized: Column) -> Column:
    """First 12 bytes of the SHA-256 of a block, as hex."""
    return F.substring(F.sha2(normalized, 256), 1, 24)


def preview(normalized_lines: Column, n: int = 4) -> Column:
    """The first ``n`` lines with text, indented, and an ellipsis."""
    shown = F.slice(F.filter(normalized_lines, lambda line: line != ""), 1, n)
    return F.concat(F.lit("    "), F.array_join(shown, "\n    "), F.lit("\n    ..."))


def first_sentence(text: Column) -> Column:
    dot = F.instr(text, ".")
    newline = F.instr(text, "\n")
    head = F.make_valid_utf8(
        F.substring(F.to_binary(text, F.lit("utf-8")), 1, 120).cast("string")
    )
    return (
        F.when(dot > 1, F.left(text, dot))
        .when(newline > 1, F.left(text, newline - 1))
        .when(F.octet_length(text) > 120, F.concat(head, F.lit("...")))
        .otherwise(text)
    )


# Words that open a function when a trimmed line starts with one and a space.
FUNCTION_WORDS = "func|def|function|public|private|protected|static|async"


def is_func_start(line: Column) -> Column:
    # The word is followed by text, as the line's white space at the end does not count.  Most lines
    # have no word at all, which a search for two letters that every word holds tells sooner.
    held = [F.contains(line, F.lit(part)) for part in ("func", "def", "p", "stat", "asyn")]
    return reduce(lambda a, b: a | b, held) & line.rlike(rf"(?d)^{INDENT}(?:{FUNCTION_WORDS}) (?=.*{NON_SPACE})")


def line_of_matches(text: Column, pattern: str) -> Column:
    """Line numbers of all matches of ``pattern``, in order; one for each match.

    ``pattern`` must not match an empty string and must not hold groups that are referred to.
    The text is read once to mark the matches; only a text with matches is cut into lines.
    """
    return let(clear_marks(text), lambda cleared: line_of_matches_in(cleared, pattern))


def line_of_matches_in(cleared: Column, pattern: str) -> Column:
    """The same in a text without mark characters, which several patterns can share."""
    none = F.array().cast("array<int>")

    def lines_of(marked: Column) -> Column:
        by_line = F.transform(
            F.split(marked, "\n", -1),
            lambda line, n: F.when(
                F.contains(line, F.lit(MARK)),
                F.array_repeat((n + 1).cast("int"), count_of(line, MARK)),
            ),
        )
        return F.flatten(F.array_compact(by_line))

    return let(
        F.regexp_replace(cleared, pattern, MARK + "$0"),
        lambda marked: F.when(F.contains(marked, F.lit(MARK)), lines_of(marked)).otherwise(none),
    )
