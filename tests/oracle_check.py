"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, name, build, sql, folder):
    """None when both sides agree, else what differs."""
    frame = build(spark, folder)
    got_columns, got = frame.columns, [tuple(row) for row in frame.collect()]
    if sql is None:
        return None if got else "no rows"
    cursor = connection.execute(sql)
    want_columns, want = [item[0] for item in cursor.description], cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    left, right = normalized(got_columns, got), normalized(want_columns, want)
    if left == right:
        return None if left else "agree, but no rows"
    only_left, only_right = set(left) - set(right), set(right) - set(left)
    return f"{len(left)} rows != {len(right)} rows; e.g. {sorted(only_left)[:1]} | {sorted(only_right)[:1]}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    arguments = sys.argv[1:]
    sf = arguments.pop(0) if arguments and arguments[0][:1].isdigit() else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, bad = duck(folder), entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if arguments and not any(name.startswith(part) for part in arguments):
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, name, build, oracles.get(name), folder)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
