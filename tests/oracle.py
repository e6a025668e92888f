"""Runs a registered query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


# DuckDB type -> Spark type of the same values.
SAME_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: tuple((cell is None, str(type(cell).__name__), cell) for cell in row)
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=key)


def compare(spark, connection, run, sql: str, folder: str) -> int:
    """Number of rows, when both sides agree."""
    df = run(spark, folder)
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected_types = {column[0]: SAME_TYPE.get(str(column[1]), str(column[1])) for column in result.description}
    expected = _rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    types = dict(df.dtypes)
    assert types == expected_types, {name: (types[name], expected_types[name]) for name in names
                                     if types[name] != expected_types[name]}
    found = _rows(df.columns, [tuple(row) for row in df.collect()])
    assert len(found) == len(expected), f"{len(found)} rows, SQL has {len(expected)}"
    for ours, theirs in zip(found, expected):
        assert ours == theirs, f"{sorted(names)}: {ours} but SQL has {theirs}"
    return len(found)
