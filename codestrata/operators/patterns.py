"""Regex rules over whole texts, with the line of each hit."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.search import ALL_FOLDED, Search, any_case, escaped, found_hits
from codestrata.functions.text import RE_SPACE, WORD, WORD_END, WORD_START, clear_marks, let
from codestrata.functions.text import line_of_matches_in
from codestrata.scale import fits_broadcast, unnest
from codestrata.schema import CRITICAL, INFO, WARNING


# One text for all rules, with the rule's identifier.
WHAT_TO_DO = "Rework what %s points at, or exclude the path."
# Rows a table of rules may have.
MOST_RULES = 200


@dataclass(frozen=True)
class Rule:
    """A rule; ``pattern`` is None for a rule with an operator of its own."""

    rule_id: str
    severity: str
    languages: tuple[str, ...]
    pattern: str | None
    title: str
    description: str
    # Every match holds one of these literals, and begins with it where tasks search in bytes;
    # texts without them are not searched.
    literals: tuple[str, ...] = ()
    advice: str | None = None
    # What documents tell to do, in place of the text for all rules.
    remedy: str | None = None
    # Python's pattern for the same in bytes, or that the pattern itself is ``plain`` enough for it;
    # a rule with neither is searched for by Spark.  With ``folds`` the literals are lower-case, and
    # stand for any case.
    in_bytes: str | None = None
    plain: bool = False
    folds: bool = False

    @property
    def byte_pattern(self) -> bytes | None:
        pattern = self.pattern if self.plain else self.in_bytes
        return pattern.encode() if pattern else None

    @property
    def suggestion(self) -> str:
        return self.advice or WHAT_TO_DO % self.rule_id


_ALL = ("Go", "Python", "Java", "TypeScript", "JavaScript")

# Identifiers, severities, languages and patterns of the rules, in rule order.
# Patterns begin with the class of their first characters and look behind it for what comes before,
# which is much quicker on long texts than a look-around at every place.  Words go on behind it by
# the character they began with.  The class names both cases, and the long s that (?iu) takes for
# an s, as a class under (?iu) folds every character of a text.
RULES = [
    Rule(
        "silent-error",
        CRITICAL,
        ("Go",),
        rf"_(?<!{WORD}_){RE_SPACE}*={RE_SPACE}*{WORD}+\.{WORD}+\(",
        "Result of a call thrown away",
        "A call's result is assigned to the blank name, so a failure leaves no trace.",
        plain=True,
        remedy="Check the returned error and log, wrap or return it.",
    ),
    Rule(
        "bare-panic",
        WARNING,
        ("Go",),
        rf"p(?<!{WORD}p)anic\(",
        "Panic instead of an error value",
        "The code stops the process where a caller could have handled an error.",
        ("panic(",),
        plain=True,
        remedy="Return an error and let the caller decide.",
    ),
    Rule(
        "broad-except",
        WARNING,
        ("Python",),
        rf"except({RE_SPACE}+Exception)?{RE_SPACE}*:",
        "Handler that catches everything",
        "An except clause without a specific type hides faults that nobody expected.",
        ("except",),
        plain=True,
        remedy="Name the exception types this code can deal with.",
    ),
    Rule(
        "print-debug",
        INFO,
        ("Go", "Python", "Java"),
        rf"[fpS](?<!{WORD}.)(?:(?<=f)mt\.Print(?:ln|f)|(?<=p)rint\(|(?<=S)ystem\.out\.print)",
        "Output by print statement",
        "Text goes straight to standard output and bypasses the logger.",
        ("fmt.Print", "print(", "System.out.print"),
        plain=True,
        remedy="Write through the project's logger at a fitting level.",
    ),
    Rule(
        "hardcoded-secret",
        CRITICAL,
        _ALL,
        rf"[aspASPTt\x{{17F}}][pPeEaAoO](?:(?<=[aA][pP])(?iu:i_?key)|(?<=[sS\x{{17F}}][eE])(?iu:cret)"
        rf"|(?<=[pP][aA])(?iu:ss(?:word|wd))|(?<=[tT][oO])(?iu:ken)){RE_SPACE}*[:=]"
        rf"{RE_SPACE}*[\"'](?iu:[A-Za-z0-9+/=_\-]{{10,}})[\"']",
        "Secret written into the source",
        "A literal next to a credential's name looks like a real key or password.",
        ("api", "secret", "passw", "token"),
        in_bytes=rf"(?:{any_case('api')}_?{any_case('key')}|{any_case('secret')}"
        rf"|{any_case('pass')}(?:{any_case('word')}|{any_case('wd')})|{any_case('token')})"
        rf"{RE_SPACE}*[:=]{RE_SPACE}*[\"'](?:[A-Za-z0-9+/=_\-]{escaped(ALL_FOLDED)}){{10,}}+[\"']",
        folds=True,
        remedy="Load it from a secret store or the environment, and revoke the old one.",
    ),
    Rule(
        "todo-fixme-critical",
        INFO,
        _ALL,
        rf"[tfhxTFHX](?<!{WORD}.)(?:(?<=[tT])(?iu:ODO)|(?<=[fF])(?iu:IXME)|(?<=[hH])(?iu:ACK)"
        rf"|(?<=[xX])(?iu:XX)){WORD_END}",
        "Open marker comment",
        "A marker for unfinished work was left in the code.",
        ("todo", "fixme", "hack", "xxx"),
        in_bytes=rf"{WORD_START}(?:{'|'.join(map(any_case, ('todo', 'fixme', 'hack', 'xxx')))}){WORD_END}",
        folds=True,
        remedy="Move it to the issue tracker and delete the marker.",
    ),
    Rule(
        "god-function",
        WARNING,
        _ALL,
        None,
        "Function too long",
        "A function is longer than the limit and likely does several things.",
        remedy="Split it into functions with one task each.",
    ),
]
RULE_NO = {rule.rule_id: n for n, rule in enumerate(RULES)}
PATTERN_RULES = [rule for rule in RULES if rule.pattern]


def given_rules(rules: DataFrame) -> tuple[Rule, ...]:
    """Rules of a table ``(rule_id, severity, languages, pattern, title, description, suggestion)``.

    They become literals of an expression, so that a pattern is compiled once in a task and no text
    is shuffled or read again for a rule; the table may have ``MOST_RULES`` rows.  They stand by
    identifier.  Null languages are all, a null title or description is the identifier, a null
    suggestion the common one.  Raises where an identifier is null, there twice or a fixed one's,
    where a severity is unknown, and where a pattern is null, matches an empty text, or refers to
    its groups.
    """
    if not fits_broadcast(rules, MOST_RULES):
        raise ValueError(f"a table of rules has {MOST_RULES} rows at most")
    columns = ["rule_id", "severity", "languages", "pattern", "title", "description", "suggestion"]
    empty = F.expr("regexp_like('', pattern)").alias("empty")
    found, taken = [], set(RULE_NO) | {None}
    for row in rules.select(*columns, empty).orderBy("rule_id").collect():
        rule_id, severity, languages, pattern, title, description, advice, matches_empty = row
        if rule_id in taken:
            raise ValueError(f"rule identifier {rule_id} is null or taken")
        if severity not in (CRITICAL, WARNING, INFO):
            raise ValueError(f"rule {rule_id} has no known severity")
        if matches_empty is not False or re.search(r"\\[1-9]|\\k<", pattern):
            raise ValueError(f"the pattern of rule {rule_id} is null, matches nothing or refers to a group")
        taken.add(rule_id)
        languages = _ALL if languages is None else tuple(languages)
        texts = (title or rule_id, description or rule_id)
        found.append(Rule(rule_id, severity, languages, pattern, *texts, advice=advice))
    return tuple(found)


def rule_numbers(rules: Sequence[Rule]) -> dict[str, int]:
    """Number of each rule: the fixed ones' own, and behind them those of further ``rules``."""
    further = [rule.rule_id for rule in rules if rule.rule_id not in RULE_NO]
    return RULE_NO | {rule_id: len(RULES) + n for n, rule_id in enumerate(further)}


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules as a table: ``(rule_no, rule_id, title, severity, languages, pattern)``."""
    return spark.createDataFrame(
        [
            (n, r.rule_id, r.title, r.severity, list(r.languages), r.pattern)
            for n, r in enumerate(RULES)
        ],
        "rule_no int, rule_id string, title string, severity string,"
        " languages array<string>, pattern string",
    )


def rules_for(languages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that apply to each row's ``language``.

    The rule table is a handful of rows; with one row per rule and language it is joined by
    equality.
    """
    single = rules.withColumn("language", F.explode("languages")).drop("languages")
    return languages.join(F.broadcast(single), "language")


def cap_locations(refs: Column, n: int = 5) -> Column:
    """First ``n`` references, and ``...`` behind them when there are ``n`` or more."""
    return F.when(
        F.size(refs) >= n, F.concat(F.slice(refs, 1, n), F.array(F.lit("...")))
    ).otherwise(refs)


def rule_hits(
    text: Column, lang: Column | None, rules: Sequence[Rule] = PATTERN_RULES
) -> Column:
    """Rules with a match, and the lines of all matches: ``array<struct<rule_no,lines>>``.

    Only texts in one of a rule's languages are searched; without ``lang`` all are.  Rules with a
    pattern for bytes are looked for in Arrow batches, the others, as of a table, by Spark.
    """
    numbers = rule_numbers(rules)
    searches = tuple(
        Search(
            numbers[rule.rule_id],
            None if lang is None else rule.languages,
            re.compile(rule.byte_pattern),
            tuple(literal.encode() for literal in rule.literals),
            rule.folds,
        )
        for rule in rules
        if rule.byte_pattern
    )
    others = [rule for rule in rules if not rule.byte_pattern]

    def hit(cleared: Column, rule: Rule) -> Column:
        applies = F.lit(True) if lang is None else lang.isin(*rule.languages)
        if rule.literals:
            held = [F.contains(cleared, F.lit(literal)) for literal in rule.literals]
            applies = applies & reduce(lambda a, b: a | b, held)
        return F.struct(
            F.lit(numbers[rule.rule_id]).alias("rule_no"),
            F.when(applies, line_of_matches_in(cleared, rule.pattern)).alias("lines"),
        )

    def hits(cleared: Column) -> Column:
        return F.array(*[hit(cleared, rule) for rule in others])

    found = []
    if searches:
        found.append(found_hits(text, F.lit("") if lang is None else lang, searches))
    if others:
        every = let(clear_marks(text), hits)
        found.append(F.filter(every, lambda hit: F.size(hit.lines) > 0))
    return F.concat(*found) if len(found) > 1 else found[0]


def with_hits(
    files: DataFrame, rules: Sequence[Rule] = PATTERN_RULES, any_language: bool = False
) -> DataFrame:
    """Add ``hits``; with ``any_language`` the files need no ``lang``."""
    lang = None if any_language else F.col("lang")
    return files.withColumn("hits", rule_hits(F.col("text"), lang, rules))


def hits_of(files_with_hits: DataFrame) -> DataFrame:
    """One row per (file, rule): ``(repo, path, rule_no, lines)``."""
    return unnest(files_with_hits, ["repo", "path"], F.inline_outer("hits"), "rule_no")


def all_refs(path: Column, lines: Column) -> Column:
    return F.transform(lines, lambda line: F.concat(path, F.lit(":"), line.cast("string")))


def capped_refs(path: Column, lines: Column, n: int = 5) -> Column:
    """A short form for display; the hits themselves are all kept."""
    return cap_locations(all_refs(path, lines), n)
