"""Queries of this package against their SQL."""

from __future__ import annotations

import os

import pytest

from codestrata.llm.oracle import ORACLE
from codestrata.llm.queries import QUERIES
from sql import differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    rows, only_spark, only_duckdb = differences(spark, SF_DIR, QUERIES[name], ORACLE[name])
    assert rows and not only_spark and not only_duckdb
