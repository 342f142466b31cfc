from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codestrata import scale
from codestrata.operators.deadcode import first_k_per_repo


@pytest.mark.parametrize("max_rows, hot_keys", [(100, 10), (0, 1), (0, 3), (3, 2)])
def test_attach_joins_the_same_rows_whatever_the_skew(spark, max_rows, hot_keys):
    # A third of the rows have one key, and some keys have no partner.
    big = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("key"), "id"
    )
    counts = big.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("key <> 7")
    dim = scale.materialize(counts.withColumn("name", F.concat(F.lit("k"), "key")), "dim")
    joined = scale.attach(big, dim, ["key"], "n", max_rows=max_rows, hot_keys=hot_keys)
    expected = sorted((row.key, row.id) for row in big.filter("key <> 7").collect())
    assert sorted((row.key, row.id) for row in joined.collect()) == expected
    assert joined.filter("name <> concat('k', key)").count() == 0


def test_hot_keys_are_not_shuffled(spark):
    big = spark.range(100).select(F.lit(1).alias("key"), "id")
    dim = scale.materialize(spark.createDataFrame([(1, 100), (2, 1)], "key int, n long"), "dim")
    joined = scale.attach(big, dim, ["key"], "n", max_rows=0, hot_keys=1)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and joined.count() == 100


def test_first_k_trims_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("repo"), "id")
    first = first_k_per_repo(rows, 2, [F.col("id").desc()])
    assert sorted(row.id for row in first.collect()) == [996, 997, 998, 999]
    plan = first._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_workspace_is_the_folder_of_the_session(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scale.workspace(spark) == folder.rstrip("/")
    stored = scale.materialize(spark.range(3), "three")
    assert stored.inputFiles()[0].replace("file://", "").startswith(folder)


def test_stored_tables_can_be_dropped(spark):
    from pathlib import Path

    from codestrata.scale import _stored, drop_stored, materialize

    held = _stored.pop(spark.sparkContext.applicationId, [])
    materialize(spark.range(3), "three")
    (target,) = _stored[spark.sparkContext.applicationId]
    assert Path(target).exists() and drop_stored(spark) == 1 and not Path(target).exists()
    _stored[spark.sparkContext.applicationId] = held
