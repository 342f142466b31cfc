"""Sources of the ``files`` table."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.paths import relative_path
from codestrata.scale import materialize
from codestrata.schema import SKIPPED_DIRECTORIES

# Bytes of file content that a task hands on at a time.
BATCH_BYTES = 32 * 1024 * 1024
# Bytes of files that a task reads, about, and entries of a directory that it hands on at a time.
TASK_BYTES = 128 * 1024 * 1024
BATCH_ENTRIES = 10_000
# What went away or may not be read is left out; any other error, as of an overloaded store, is
# raised, so that the task is tried again and no part of a corpus is lost unseen.
UNREADABLE = (FileNotFoundError, PermissionError)


def list_tree(
    spark: SparkSession, root: str, skipped: tuple[str, ...] = tuple(SKIPPED_DIRECTORIES)
) -> DataFrame:
    """``(path, size)`` of the files below ``root``, names in ``skipped`` pruned.

    Spark's own file sources leave out empty files and names that start with ``_`` or ``.``,
    which source trees are full of.  Every level of the tree is one job over its directories, so
    a large repository is listed by many tasks.  Directories behind links are not entered, and
    what is gone or may not be read is left out.
    """
    uri = _uri(root)
    _, base = fs.FileSystem.from_uri(uri)

    unreadable, batch_entries = UNREADABLE, BATCH_ENTRIES

    # The functions that run in tasks use nothing of this package, which executors may not have.
    def entries_of(store: fs.FileSystem, directory: str) -> pd.DataFrame:
        try:
            infos = store.get_file_info(fs.FileSelector(directory))
        except unreadable:
            infos = []
        rows = []
        for info in infos:
            is_dir = info.type == fs.FileType.Directory
            linked = isinstance(store, fs.LocalFileSystem) and os.path.islink(info.path)
            if is_dir and (linked or info.base_name in skipped):
                continue
            if is_dir or info.type == fs.FileType.File:
                rows.append((info.path, is_dir, info.size or 0))
        return pd.DataFrame(rows, columns=["path", "is_dir", "size"])

    def list_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for directory in batch["path"]:
                entries = entries_of(store, directory)
                for start in range(0, len(entries), batch_entries):
                    yield entries[start : start + batch_entries]

    level = spark.createDataFrame([(base,)], "path string")
    found: list[DataFrame] = []
    while True:
        entries = level.mapInPandas(list_batch, "path string, is_dir boolean, size long")
        entries = materialize(entries, "tree-level")
        found.append(entries.filter("NOT is_dir").select("path", "size"))
        level = entries.filter("is_dir").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = level.repartition(spark.sparkContext.defaultParallelism)


def _uri(root: str) -> str:
    return root if "://" in root else os.path.abspath(root)


def read_corpus(
    spark: SparkSession,
    root: str,
    repo: Column | None = None,
    extensions: tuple[str, ...] | None = None,
    files_per_task: int = 2_000,
) -> DataFrame:
    """Read the tree below ``root`` as ``(repo, path, text)``.

    Without ``repo`` the first directory below ``root`` is the repository.  With ``extensions``
    only files that end in one of them are read; the others keep their row, with a NULL text.
    Files that are gone or may not be read are left out; bytes that are not UTF-8 become U+FFFD.
    A file whose name ends like a compressed one, as in ``.zst``, is read as what it holds.
    """
    listed = materialize(list_tree(spark, root), "tree")
    n_files, n_bytes = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parallel = spark.sparkContext.defaultParallelism
    tasks = max(parallel, n_files // files_per_task, n_bytes // TASK_BYTES)
    uri = _uri(root)
    _, base = fs.FileSystem.from_uri(uri)
    unreadable = UNREADABLE

    def read_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(uri)
        rows: list[tuple[str, bytes | None]] = []
        held = 0
        for batch in batches:
            for path in batch["path"]:
                content = None
                if extensions is None or path.lower().endswith(extensions):
                    try:
                        with store.open_input_stream(path) as stream:
                            content = stream.read()
                    except unreadable:
                        continue
                rows.append((path, content))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=["path", "content"])

    # Spread by path, so that the files of one repository are read by many tasks.
    loaded = (
        listed.select("path")
        .repartition(tasks, "path")
        .mapInPandas(read_batch, "path string, content binary")
    )
    below = relative_path(F.col("path"), base.rstrip("/"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    if repo is not None:
        return loaded.select(repo.alias("repo"), below.alias("path"), text.alias("text"))
    return loaded.select(
        F.substring_index(below, "/", 1).alias("repo"),
        F.regexp_replace(below, "^[^/]*/", "").alias("path"),
        text.alias("text"),
    )


def corpus_from_table(table: DataFrame, repo: Column, path: Column, text: Column) -> DataFrame:
    """Use columns of any table as a corpus."""
    return table.select(
        repo.cast("string").alias("repo"),
        path.cast("string").alias("path"),
        F.make_valid_utf8(text).alias("text"),
    )
