"""Run a query and its SQL check over the same folder and compare all rows."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(df, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if names, number of rows and every value agree, types included."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    found = _rows(df.columns, [tuple(row) for row in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if len(found) != len(expected):
        return f"{len(found)} rows instead of {len(expected)}"
    for mine, theirs in zip(found, expected):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"row {str(mine)[:600]}\ninstead of {str(theirs)[:600]}"
    return ""
