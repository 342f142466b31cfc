"""Compare a query with its SQL; decimals and doubles are compared to nine places."""

from __future__ import annotations

from compare import connect, rows_of


def differences(spark, sf_dir: str, query, sql: str) -> tuple[int, list, list]:
    found = query(spark, sf_dir)
    left = rows_of(found.columns, [tuple(row) for row in found.collect()])
    cursor = connect(sf_dir).execute(sql)
    columns = [column[0] for column in cursor.description]
    assert sorted(columns) == sorted(found.columns), (columns, found.columns)
    wide = [c[0] for c in cursor.description if "HUGE" in str(c[1]) or "DECIMAL" in str(c[1])]
    assert not wide, wide
    right = rows_of(columns, cursor.fetchall())
    return left.total(), list((left - right).items())[:3], list((right - left).items())[:3]
