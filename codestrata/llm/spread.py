"""Running sums over large groups, native, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(
    rows: DataFrame, group: list[str], bucket: Column, order: list, size: str, name: str
) -> DataFrame:
    """Add ``name``: the sum of ``size`` over the rows before each row of its group.

    ``bucket`` must rise with ``order``.  A task sorts one bucket of a group; the sums of whole
    buckets, a small table, are added up apart and joined on.
    """
    rows = rows.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    sums = rows.groupBy(*keys).agg(F.sum(size).alias("_sum"))
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = F.coalesce(F.sum(size).over(inside), F.lit(0))
    left, right = rows.withColumn("_within", within).alias("l"), sums.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    kept = [F.col(f"l.{c}") for c in rows.columns if c != "_bucket"]
    total = (F.col("l._within") + F.col("r._before")).alias(name)
    return left.join(right, same).select(*kept, total)
