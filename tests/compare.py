"""Run a query in Spark and its SQL in DuckDB and compare the rows, whatever their order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark: SparkSession, sf_dir: str, query, sql: str) -> tuple[int, list, list]:
    """Number of rows, and a few rows only Spark has and only DuckDB has."""
    found = query(spark, sf_dir)
    left = rows_of(found.columns, [tuple(row) for row in found.collect()])
    cursor = connect(sf_dir).execute(sql)
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(found.columns), (columns, found.columns)
    kinds = {column[0]: str(column[1]).upper() for column in cursor.description}
    doubles = {name for name, kind in found.dtypes if kind == "double"}
    wide = [
        name
        for name, kind in kinds.items()
        if kind in ("HUGEINT", "DECIMAL") or kind == "DOUBLE" and name not in doubles
    ]
    assert not wide, f"integers that a reader would turn into floats: {wide}"
    right = rows_of(columns, cursor.fetchall())
    return left.total(), list((left - right).items())[:3], list((right - left).items())[:3]
