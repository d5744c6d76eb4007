"""Compares a Spark result with its SQL twin: row count, column names and values, in any row order."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal

import duckdb

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    """One spelling per value; doubles keep all their digits."""
    if isinstance(value, (bool, type(None), str)):
        return value
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return "NaN" if math.isnan(number) else repr(number + 0.0)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when both sides agree."""
    cursor = con.execute(sql)
    names, kinds = [c[0] for c in cursor.description], [str(c[1]) for c in cursor.description]
    expected = cursor.fetchall()
    got = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns differ: {sorted(set(names) ^ set(spark_df.columns))}"]
    problems = []
    if len(expected) != len(got):
        problems.append(f"rows: spark {len(got)}, sql {len(expected)}")
    a, b = sorted_rows(spark_df.columns, got), sorted_rows(names, expected)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        labels = sorted(names)
        x, y = wrong[0]
        problems.append(f"{len(wrong)} rows differ, first: {[(l, u, v) for l, u, v in zip(labels, x, y) if u != v]}")
    same = {"BIGINT": "bigint", "DOUBLE": "double", "INTEGER": "int", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
            "TIMESTAMP": "timestamp"}
    types = dict(spark_df.dtypes)
    off = {n: (types[n], k) for n, k in zip(names, kinds) if same.get(k) != types[n]}
    if off:
        problems.append(f"types differ: {off}")
    return problems
