"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


TIMES = {"spark": 0.0}


def checker(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and value != value:
        return "NaN"
    if isinstance(value, Decimal):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def differences(spark, con, fn, sql: str, sf: str) -> str | None:
    started = time.time()
    got = fn(spark, sf)
    found = rows_of(got.columns, got.collect())
    TIMES["spark"] = time.time() - started
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    wanted = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} against {sorted(columns)}"
    if found == wanted:
        return None
    left, right = set(map(repr, found)), set(map(repr, wanted))
    return (
        f"{len(found)} rows against {len(wanted)}; only here {sorted(left - right)[:2]}; "
        f"only there {sorted(right - left)[:2]}"
    )


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from graphmill.session import get_spark

    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    con = checker(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                result = differences(spark, con, queries[name], oracles[name], sf) or "same"
            else:
                result = f"rows only: {queries[name](spark, sf).count()}"
        except Exception as error:  # noqa: BLE001
            result = "ERROR " + repr(error)[:900]
        print(f"{name:28} {time.time() - start:6.2f}s {TIMES['spark']:6.2f}s {result}", flush=True)
