"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_entry(spark):
    assert entry(spark).columns == ["repo", "total_files", "criticals", "score"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    query = queries()[name]
    if name not in oracle_sql():
        assert query(spark, SF_DIR).count() > 0
        return
    _, only_spark, only_duckdb = differences(spark, SF_DIR, query, oracle_sql()[name])
    assert not only_spark and not only_duckdb
