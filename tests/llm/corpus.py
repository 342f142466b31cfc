"""Small documents that hold every awkward case, and plain ways to work out results."""

from __future__ import annotations

import random
import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, size string,"
    " node string, row string, token string, score string, held_out string"
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

STEMS = {
    "en": "the ther tion ing and ough ness hand that with".split(),
    "de": "und schl keit über ung der nicht zwei lich auf".split(),
    "fr": "eau oux ment était que les aille pour ègne vous".split(),
}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    """Prose with copies, near copies, shared passages, nulls, blanks, one very long text, repeats."""
    rng = random.Random(seed)
    passage, long_text = prose(rng, 60), prose(rng, 30_000)
    texts: list[tuple[int | None, str | None, str | None, str | None]] = []
    for doc_id in range(n):
        lang = ("en", "de", "fr")[doc_id % 3]
        texts.append((doc_id, prose(rng, rng.randint(1, 300), lang), lang, f"s{doc_id % 4 % 3}"))
    for k in range(12):
        base = texts[3][1].split()
        base[rng.randrange(len(base))] = f"changed{k}"
        texts.append((100 + k, " ".join(base), "en", "s0"))
    for k in range(6):
        text = f"{prose(rng, 50)}\n{passage} {prose(rng, 40)}"
        texts.append((200 + k, text, "en", None))
    texts += [(300, texts[5][1], "fr", "s1"), (301, texts[5][1].upper(), "fr", "s1")]
    texts += [(302, None, "en", "s0"), (303, "", None, "s0"), (304, " \t\n ", "de", None)]
    texts += [(305, "!!! 123 ###", "de", "s2"), (306, "one", "en", "s2"), (307, "one", None, "s2")]
    texts += [(None, passage, "en", "s1"), (None, None, None, None), (308, long_text, "en", "s0")]
    texts += [(309, "é è  ü　\tñ\x0b\x0cz", "fr", "s2")]
    texts += [texts[7], texts[7], (7, "another text with the same id as before", "en", "s0")]
    return [
        (i, t, lang, source, len(t or ""), "k", "s", "n", "r", "t", "x", "h")
        for i, t, lang, source in texts
    ]


def table(spark, found: list[tuple]):
    return spark.createDataFrame(found, SCHEMA)
