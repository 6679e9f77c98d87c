"""Compares registered queries with their oracle SQL; run as a script or from pytest."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

GIVEN = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in GIVEN:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def in_order(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


# Spark type names and the DuckDB names they stand for.
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def differences(spark_df, connection, oracle: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    result = connection.execute(oracle)
    names = [d[0] for d in result.description]
    want = in_order(names, result.fetchall())
    got = in_order(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    odd = {n: (k, kinds[n]) for n, k in spark_df.dtypes if TYPES.get(k, k) != kinds[n]}
    if odd:
        return f"types {odd}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want), key=repr)[:2]
        missing = sorted(set(want) - set(got), key=repr)[:2]
        return f"{len(got)} rows against {len(want)}; extra {extra}; missing {missing}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"row {g} against {w}"
    return None


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as registered

    folder = sys.argv[1]
    names = sys.argv[2:] or list(registered.queries())
    spark, connection = session(), connect(folder)
    bad = 0
    for name in names:
        run, oracle = registered.queries()[name], registered.oracle_sql().get(name)
        start = time.time()
        try:
            df = run(spark, folder)
            problem = differences(df, connection, oracle) if oracle else f"rows only: {df.count()}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error).splitlines()[0][:400]}"
        ok = problem is None or problem.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(main())
