"""Run a report in Spark and its twin in DuckDB, and compare all values exactly."""

from __future__ import annotations

import datetime

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.date()
    return 0.0 if value == 0 and isinstance(value, float) else value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    return _sorted([d[0] for d in result.description], result.fetchall())


def difference(spark_result, duck_result) -> str | None:
    """None if equal, else the first difference."""
    (names, rows), (other_names, other_rows) = spark_result, duck_result
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(rows) != len(other_rows):
        return f"{len(rows)} rows != {len(other_rows)}"
    bad = [(a, b) for a, b in zip(rows, other_rows) if a != b]
    types = [(type(x), type(y)) for a, b in zip(rows, other_rows) for x, y in zip(a, b)
             if x is not None and y is not None and type(x) is not type(y)]
    if types:
        return f"types differ: {types[0]}"
    if bad:
        a, b = bad[0]
        cells = {n: (x, y) for n, x, y in zip(names, a, b) if x != y}
        return f"{len(bad)} rows differ, first: {cells}"
    return None
