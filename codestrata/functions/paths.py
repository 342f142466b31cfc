"""Path predicates.  They read only ``path`` (and ``repo``), never the text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.schema import LAYERS, SKIPPED_DIRECTORIES


def components(path: Column) -> Column:
    """Path components; ordering by this array is the order of a depth-first, by-name walk."""
    return F.split(path, "/", -1)


def directories(path: Column) -> Column:
    parts = components(path)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def extension(path: Column) -> Column:
    """Lower-cased text from the last dot of the base name on; '' without a dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def relative_path(path: Column, root: str) -> Column:
    """``path`` without the root prefix and one slash; ``path`` itself if nothing is left."""
    rest = F.when(
        F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 2**31 - 1)
    ).otherwise(path)
    rest = F.when(rest.startswith("/"), F.substring(rest, 2, 2**31 - 1)).otherwise(rest)
    return F.when(rest == "", path).otherwise(rest)


def in_directory(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(directories(path), F.array(*[F.lit(n) for n in names]))


def in_skipped_directory(path: Column, repo: Column | None = None) -> Column:
    """A directory component, or the repository's own name, is on the skip list."""
    hit = in_directory(path, SKIPPED_DIRECTORIES)
    if repo is not None:
        hit = hit | F.substring_index(repo, "/", -1).isin(SKIPPED_DIRECTORIES)
    return hit


def glob_regex(glob: str) -> str | None:
    """Anchored regex of a one-component glob; None if the glob is malformed."""
    out, i = [], 0
    while i < len(glob):
        char = glob[i]
        i += 1
        if char == "*":
            out.append("[^/]*")
        elif char == "?":
            out.append("[^/]")
        elif char == "\\":
            if i == len(glob):
                return None
            out.append(_literal(glob[i]))
            i += 1
        elif char == "[":
            members, i = _glob_class(glob, i)
            if members is None:
                return None
            out.append(members)
        else:
            out.append(_literal(char))
    return "(?s)^" + "".join(out) + r"\z"


def _literal(char: str) -> str:
    return char if char.isalnum() or char == "_" or ord(char) > 127 else "\\" + char


def _glob_class(glob: str, i: int) -> tuple[str | None, int]:
    """Regex of the class that starts behind ``[`` at ``i``, and the index behind it."""
    negated = glob[i : i + 1] == "^"
    i += negated
    ranges: list[str] = []
    n_ranges = 0
    while True:
        if glob[i : i + 1] == "]" and n_ranges:
            if not ranges:
                return ("." if negated else "(?!)"), i + 1
            return f"[{'^' if negated else ''}{''.join(ranges)}]", i + 1
        bounds: list[str] = []
        while len(bounds) < 2:
            if i >= len(glob) or glob[i] in "-]":
                return None, i
            if glob[i] == "\\":
                i += 1
                if i >= len(glob):
                    return None, i
            bounds.append(glob[i])
            i += 1
            if i >= len(glob):
                return None, i
            if len(bounds) == 1 and glob[i] != "-":
                bounds.append(bounds[0])
            elif len(bounds) == 1:
                i += 1
        n_ranges += 1
        # A range that runs backwards is legal in a glob and holds no character.
        if bounds[0] <= bounds[1]:
            ranges.append(f"{_literal(bounds[0])}-{_literal(bounds[1])}")


def _matches_pattern(path: Column, pattern: str) -> Column:
    if pattern.startswith("**/") and pattern.endswith("/**"):
        name = pattern[3:].removesuffix("/**")
        return F.contains(path, F.lit(f"/{name}/")) | F.startswith(path, F.lit(f"{name}/"))
    if not pattern.startswith("**/") and pattern.endswith("/"):
        name = pattern[:-1]
        return F.lit(name == ".") | (
            F.contains(path, F.lit(f"/{name}/"))
            | F.startswith(path, F.lit(f"{name}/"))
            | (path == name)
        )
    regex = glob_regex(pattern.removeprefix("**/"))
    if regex is None or "/" in pattern.removeprefix("**/"):
        return F.lit(False)
    # A directory that matches is pruned with all below it, and the root is tested as ".".
    return F.exists(components(path), lambda part: part.rlike(regex)) | F.lit(".").rlike(regex)


def is_excluded(path: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """``path`` is hit by one of the exclude patterns, itself or through a directory."""
    return reduce(lambda a, b: a | b, [_matches_pattern(path, p) for p in patterns], F.lit(False))


# Layers and the words, as a pattern, that names of each hold; in order of priority.
Layers = Sequence[tuple[str, str]]


def layer_of(name: Column, layers: Layers = LAYERS) -> Column:
    """First layer, in priority order, with a word in ``name``; NULL if there is none."""
    cases = [F.when(name.rlike(f"(?iu){words}"), layer) for layer, words in layers]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def layer_of_path(path: Column, root: str = "", layers: Layers = LAYERS) -> Column:
    """Layer of the outermost path component that belongs to any."""
    whole = F.concat(F.lit(root.rstrip("/") + "/"), path) if root else path
    found = F.transform(components(whole), lambda part: layer_of(part, layers))
    return F.get(F.filter(found, lambda layer: layer.isNotNull()), F.lit(0))


def exclude_regexes(pattern: str) -> tuple[str | None, str | None]:
    """An exclude pattern as a regex of the whole path, or as one of a single component.

    Both are None for a pattern that hits nothing; an empty regex hits every path.
    """
    if pattern.startswith("**/") and pattern.endswith("/**"):
        name = "".join(map(_literal, pattern[3:].removesuffix("/**")))
        return f"(?:^|/){name}/", None
    if not pattern.startswith("**/") and pattern.endswith("/"):
        name = "".join(map(_literal, pattern[:-1]))
        return ("" if pattern == "./" else rf"(?:^|/){name}/|^{name}\z"), None
    glob = pattern.removeprefix("**/")
    regex = None if "/" in glob else glob_regex(glob)
    # The root is tested as ".", which Python's own engine can do for a glob of one component.
    if regex is not None and re.match(regex.replace(r"\z", r"\Z"), "."):
        return "", None
    return None, regex
