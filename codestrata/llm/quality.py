"""Quality rules as a short-circuit cascade, cheapest rejection first.

A rule is a condition that a text must meet.  On a bounded sample each rule is timed and its
rejections are counted; the cascade asks the rules in the order of rejections per second, and a
text that one rejects is not shown to the rest.  The order changes how long it takes, never the
verdict, which is that all rules hold.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.scale import materialize

# Texts that rules are measured on, about; their number does not grow with the table.
SAMPLE_TEXTS = 2000
# A rule is timed this often on the sample; the shortest time counts.
TIMINGS = 2


@dataclass(frozen=True)
class Rule:
    """A named condition over the columns that `with_text_stats` adds; null counts as not met."""

    name: str
    holds: str


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rejections_per_second(self) -> float:
        return self.rejected / self.seconds


# Shares are kept as products of whole numbers, so that every engine rounds alike.
RULES = (
    Rule("enough_words", "n_words >= 50"),
    Rule("few_repeated_words", "100 * n_repeat_words <= 50 * n_words"),
    Rule("mean_word_length", "word_chars >= 2 * n_words AND word_chars <= 20 * n_words"),
    Rule("few_symbols", "10 * n_symbols <= n_words"),
    Rule("few_repeated_lines", "2 * n_dup_lines <= n_lines"),
    Rule("few_pipes_and_bullets", "10 * (length(text) - length(regexp_replace(text, '[|•]+', ''))) <= n_words"),
    Rule("few_capitals", "10 * (length(text) - length(regexp_replace(text, '[A-Z]+', ''))) <= 3 * word_chars"),
    Rule("few_exclamations", "10 * (length(text) - length(regexp_replace(text, '[!?]+', ''))) <= n_words"),
    Rule("few_digits", "10 * (length(text) - length(regexp_replace(text, '[0-9]+', ''))) <= 3 * word_chars"),
)
BASE_RULES = ("enough_words", "few_repeated_words")


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    Windows are compared as 64-bit hashes of three words.  Most short texts have as many different
    windows as windows, and then nothing is sorted.  Else each window becomes one number, the
    upper bits of its hash above its place, as many as the number of windows needs; sorted, equal
    windows are neighbours, and whole hashes decide.
    """
    # Places 0, 1, … of the windows; texts of fewer than three words have none.
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda word, n: F.xxhash64(word, F.get(words, n + 1), F.get(words, n + 2)),
    )

    def place_mask(found: Column) -> Column:
        mask = F.lit((1 << 31) - 1)
        for bits in (24, 20, 16, 12):
            mask = F.when(F.size(found) <= 1 << bits, F.lit((1 << bits) - 1)).otherwise(mask)
        return mask.cast("long")

    def covered(found: Column, mask: Column) -> Column:
        numbers = F.transform(
            found, lambda h, n: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(n.cast("long"))
        )

        def same(number: Column, other: Column) -> Column:
            # Numbers that differ in the highest bit make a negative one, which is not near.
            apart = number.bitwiseXOR(other)
            hashes = [F.get(found, x.bitwiseAND(mask).cast("int")) for x in (number, other)]
            return (apart <= mask) & (apart >= 0) & (hashes[0] == hashes[1])

        def repeated(ordered: Column) -> Column:
            marked = F.transform(
                ordered,
                lambda number, n: F.when(
                    same(number, F.get(ordered, n + 1)) | same(number, F.get(ordered, n - 1)),
                    number.bitwiseAND(mask),
                ),
            )
            return F.sort_array(F.array_compact(marked))

        return _let(F.sort_array(numbers), lambda ordered: _let(repeated(ordered), _span_words))

    def counted(found: Column) -> Column:
        all_differ = F.size(F.array_distinct(found)) == F.size(found)
        return F.when(all_differ, F.lit(0).cast("long")).otherwise(
            _let(place_mask(found), lambda mask: covered(found, mask))
        )

    return _let(hashes, counted)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _span_words(places: Column) -> Column:
    """Words covered by windows of three that start at sorted, different places."""
    gaps = F.transform(
        places, lambda place, n: F.least(F.get(places, n + 1) - place, F.lit(3).cast("long"))
    )
    # The last window has none behind it; nulls do not count in a least.
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)


def _without(text: Column, pattern: str) -> Column:
    """Number of characters of ``text`` that ``pattern`` matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_text_stats(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Add ``text`` and its counts; those of a null or empty text are 0."""
    whole = F.coalesce(F.col(text_column), F.lit(""))
    parts = F.array_remove(F.split(whole, "[ \\x09-\\x0D]+"), "")
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike("[^ \\x09-\\x0D]"))
    counted = _let(
        parts,
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        ),
    )
    by_line = _let(
        lines,
        lambda found: F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        ),
    )
    return (
        docs.withColumns({"text": whole, "_counts": counted, "_lines": by_line})
        .select("*", "_counts.*", "_lines.*", _without(F.col("text"), "[#*$%&|<>]+").alias("n_symbols"))
        .drop("_counts", "_lines")
    )


def measure(stats: DataFrame, rules: tuple[Rule, ...]) -> list[Measured]:
    """Seconds and rejected share of each rule over ``stats``, which should be a stored sample."""
    found = []
    for rule in rules:
        seconds = []
        for _ in range(TIMINGS):
            start = time.perf_counter()
            rows, kept = stats.agg(
                F.count(F.lit(1)), F.count_if(F.expr(rule.holds))
            ).first()
            seconds.append(time.perf_counter() - start)
        found.append(Measured(rule, max(min(seconds), 1e-9), 1 - kept / rows if rows else 0.0))
    return found


def cascade(rules: list[Rule]) -> Column:
    """Whether all rules hold; a rule behind one that fails is not evaluated."""
    return reduce(
        lambda rest, rule: F.when(F.coalesce(F.expr(rule.holds), F.lit(False)), rest).otherwise(False),
        reversed(rules),
        F.lit(True),
    )


def quality(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rules: tuple[Rule, ...] = RULES,
    base: tuple[str, ...] = BASE_RULES,
    sample_texts: int = SAMPLE_TEXTS,
) -> DataFrame:
    """Counts and verdict of each document.

    ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)``.
    The ``base`` rules only need counts that are part of the result, so they are asked first; the
    others follow in the order that a sample of about ``sample_texts`` texts shows to be the best.
    A null text counts as empty and fails; a null id stays null; repeated rows are judged each;
    other columns are left out, and an empty table gives no rows.
    """
    texts = docs.select(
        docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")
    )
    first = [rule for rule in rules if rule.name in base]
    rest = tuple(rule for rule in rules if rule.name not in base)
    n_texts = docs.count()
    fraction = min(1.0, sample_texts / max(n_texts, 1))
    sample = with_text_stats(texts.sample(fraction, 1).limit(2 * sample_texts))
    sample = materialize(sample.filter(_all_hold(first)), "quality-sample")
    order = sorted(measure(sample, rest), key=lambda m: (-m.rejections_per_second, m.rule.name))
    stats = with_text_stats(texts)
    failed = ~_all_hold(first)
    verdict = F.when(failed, False).otherwise(cascade([m.rule for m in order]))
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        verdict.alias("kept"),
    )


def _all_hold(rules: list[Rule]) -> Column:
    return reduce(lambda a, rule: a & F.coalesce(F.expr(rule.holds), F.lit(False)), rules, F.lit(True))
