"""Groups of equal function blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.segment import blocks_of
from codestrata.scale import attach, materialize


def duplicate_groups(blocks: DataFrame, across_repos: bool = False) -> DataFrame:
    """``(repo, hash, preview, n)`` of blocks that occur at least twice in a repository.

    Equal hashes have equal previews, so the preview is part of the grouping key: counts are
    combined in each task and a hash of any size shuffles one row per task.  With
    ``across_repos`` the groups span the corpus and there is no ``repo`` column.
    """
    keys = ["hash", "preview"] if across_repos else ["repo", "hash", "preview"]
    return blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def duplicate_locations(
    blocks: DataFrame, groups: DataFrame, across_repos: bool = False
) -> DataFrame:
    """Every member of every group as its own row: ``(repo, hash, path, line, n)``.

    ``groups`` should be a stored table.  Bodies and previews are not shuffled, and no group is
    gathered in one place.
    """
    keys = ["hash"] if across_repos else ["repo", "hash"]
    members = blocks.select("repo", "path", "line", "hash")
    return attach(members, groups.select(*keys, "n"), keys, "n")


def duplicate_blocks(
    files_with_blocks: DataFrame, across_repos: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Groups and their locations; the groups are stored once and read by both."""
    groups = duplicate_groups(blocks_of(files_with_blocks, ["hash", "preview"]), across_repos)
    groups = materialize(groups, "duplicate-groups")
    members = blocks_of(files_with_blocks, ["line", "hash"])
    return groups, duplicate_locations(members, groups, across_repos)


def severity_of_copies(n):
    return F.when(n >= 3, "CRITICAL").otherwise("WARNING")
