"""Helpers that keep joins and intermediate tables safe on large, skewed data."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows a side may have to be broadcast, after counting them.
BROADCAST_ROWS = 200_000
# Keys taken out of a skewed join.  After the HOT_KEYS heaviest keys are gone, no other key can
# hold more than 1 / HOT_KEYS of the rows.
HOT_KEYS = 1_000

_local_folders: dict[str, str] = {}
_stored: dict[str, list[str]] = {}
_scopes = threading.local()


def workspace(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a session in local mode, where driver and executors are one process, gets a folder of
    its own without that setting; it goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="codestrata-")
        atexit.register(shutil.rmtree, _local_folders[app], ignore_errors=True)
    return _local_folders[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the workspace and read it back.

    Cuts the lineage in storage that outlives executors, so a lost executor re-reads files
    instead of recomputing everything before them.
    """
    spark = df.sparkSession
    target = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    scopes = getattr(_scopes, "open", [])
    stored = scopes[-1] if scopes else _stored.setdefault(spark.sparkContext.applicationId, [])
    stored.append(target)
    return spark.read.schema(df.schema).parquet(target)


def delete(spark: SparkSession, target: str) -> None:
    """Delete a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders and files whose paths match ``pattern``, in which ``*`` stands for any name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that this session stored, when no DataFrame reads them any more."""
    targets = _stored.pop(spark.sparkContext.applicationId, [])
    for target in targets:
        delete(spark, target)
    return len(targets)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what `materialize` stores in this thread until the end of the block.

    For work that leaves its results elsewhere, such as a batch of a stream.
    """
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append([])
    try:
        yield
    finally:
        for target in scopes.pop():
            delete(spark, target)


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than that plus one."""
    bound = BROADCAST_ROWS if max_rows is None else max_rows
    return df.limit(bound + 1).count() <= bound


def unnest(df: DataFrame, keep: list[str], generator: Column, required: str) -> DataFrame:
    """Rows of an outer ``generator`` behind the columns to ``keep``, without its NULL rows.

    ``required`` is a generated column that is never NULL in a real row.  For the generators
    that are not outer the optimizer puts a filter on the array below them, which computes a
    costly array twice.
    """
    return df.select(*keep, generator).filter(F.col(required).isNotNull())


def attach(
    big: DataFrame,
    dim: DataFrame,
    keys: list[str],
    weight: str,
    max_rows: int | None = None,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Inner join of ``big`` with a table that has one row per key, whatever the skew.

    ``weight`` names the column of ``dim`` that counts the rows of ``big`` per key.  A small
    ``dim`` is broadcast after its rows were counted.  A large one is split: the heaviest
    ``hot_keys`` keys are broadcast, the rest is a shuffle join in which no key can be hot.
    ``dim`` should be a stored table, as it is read more than once.
    """
    if fits_broadcast(dim, max_rows):
        return big.join(F.broadcast(dim), keys)
    hot = dim.orderBy(F.col(weight).desc(), *keys).limit(hot_keys)
    hot = materialize(hot, "hot-keys")
    hot_keys_only = F.broadcast(hot.select(*keys))
    cold = dim.join(hot_keys_only, keys, "left_anti")
    return big.join(F.broadcast(hot), keys).unionByName(
        big.join(hot_keys_only, keys, "left_anti").join(cold.hint("merge"), keys)
    )
