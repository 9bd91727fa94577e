"""Run registered queries on Spark and their statements on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import ORACLES, QUERIES, TABLES


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else ("float", value + 0.0)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, datetime.datetime):
        return ("time", value.replace(tzinfo=None).isoformat())
    if isinstance(value, (list, tuple)):
        return ("list", tuple(_plain(v) for v in value))
    return (type(value).__name__, str(value))


def normal_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def oracle_rows(sf_dir: str, statement: str) -> tuple[list[str], list[tuple]]:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    cursor = connection.execute(statement)
    columns = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    connection.close()
    return columns, rows


def compare(spark: SparkSession, sf_dir: str, name: str) -> tuple[bool, str]:
    """Whether the rows agree, and what was found."""
    start = time.time()
    result = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in result.collect()]
    spent = time.time() - start
    if name not in ORACLES:
        return len(rows) > 0, f"{len(rows)} rows in {spent:.1f}s, no statement"
    start = time.time()
    columns, expected = oracle_rows(sf_dir, ORACLES[name])
    note = f"{len(rows)} rows in {spent:.1f}s (statement {time.time() - start:.1f}s)"
    if sorted(columns) != sorted(result.columns):
        return False, f"columns {sorted(result.columns)} instead of {sorted(columns)}"
    ours, theirs = normal_rows(result.columns, rows), normal_rows(columns, expected)
    if ours == theirs:
        return len(ours) > 0, note
    extra = [r for r in ours if r not in set(theirs)][:2]
    lacking = [r for r in theirs if r not in set(ours)][:2]
    return False, f"{note}, {len(theirs)} expected; only here {extra}; only there {lacking}"


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    for name in QUERIES:
        if names and not any(n in name for n in names):
            continue
        try:
            good, note = compare(spark, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not good
        print("ok  " if good else "FAIL", name, note, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
