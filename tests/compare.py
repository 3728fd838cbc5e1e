"""Comparison of a Spark result with an independent engine's result, without regard to row order."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import duckdb

SOURCE_TABLES = "region nation customer supplier part orders lineitem".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in SOURCE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, datetime) and value.time() == datetime.min.time():
        return value.date()
    return value


def difference(spark_df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns, types and rows; otherwise a description."""
    names = sorted(spark_df.columns)
    result = connection.execute(sql)
    oracle_names = [d[0] for d in result.description]
    if sorted(oracle_names) != names:
        return f"columns {names} != {sorted(oracle_names)}"
    order = [oracle_names.index(n) for n in names]
    expected = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    actual = Counter(tuple(_plain(v) for v in row) for row in spark_df.select(*names).collect())
    if actual == expected:
        return _type_difference(spark_df, connection, sql)
    return (
        f"rows {sum(actual.values())} != {sum(expected.values())}; "
        f"only here {list((actual - expected))[:2]}; only there {list((expected - actual))[:2]}"
    )


# Both engines' names of one type.
SAME_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}


def _type_difference(spark_df, connection, sql) -> str | None:
    described = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = {
        f.name: (f.dataType.simpleString(), described[f.name])
        for f in spark_df.schema.fields
        if SAME_TYPE.get(f.dataType.simpleString()) != described[f.name]
    }
    return f"types {wrong}" if wrong else None



