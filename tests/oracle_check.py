"""Compare a Spark result with DuckDB's: columns, row count and every value."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


def differences(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    result = connection.sql(sql)
    names = sorted(frame.columns)
    if names != sorted(result.columns):
        return f"columns {names} != {sorted(result.columns)}"
    ours = Counter(tuple(row[n] for n in names) for row in frame.collect())
    order = [result.columns.index(n) for n in names]
    theirs = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    if ours == theirs:
        return None
    return (
        f"{sum(ours.values())} rows vs {sum(theirs.values())}; "
        f"only ours {list((ours - theirs).items())[:3]}; only theirs {list((theirs - ours).items())[:3]}"
    )
