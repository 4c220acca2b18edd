"""Comparing a Spark result with the result of the comparison SQL."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def ordered(columns, rows):
    names = sorted(columns)
    spots = [list(columns).index(name) for name in names]
    table = [tuple(plain(row[i]) for i in spots) for row in rows]
    return names, sorted(table, key=repr)


def differences(df, connection, sql, limit=5):
    """Column names and rows that differ, exact to the last digit; empty if equal."""
    mine = ordered(df.columns, [tuple(row) for row in df.collect()])
    cursor = connection.execute(sql)
    rows = cursor.fetchall()
    theirs = ordered([column[0] for column in cursor.description], rows)
    if mine[0] != theirs[0]:
        return [("columns", mine[0], theirs[0])]
    if len(mine[1]) != len(theirs[1]):
        return [("rows", len(mine[1]), len(theirs[1]))]
    return [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b][:limit]
