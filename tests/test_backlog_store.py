"""The stored backlog: runs, a broken-off run, and what an upsert touches."""

from __future__ import annotations

import datetime
import glob
import os

from pyspark.sql import functions as F

from sqltide.operators import backlog_store
from sqltide.operators.knowledge import with_fresh_cases
from sqltide.schemas import CASE

NOW = datetime.datetime(2024, 1, 1)


def cases(spark, names, day, gain=0.5):
    rows = [
        (f"id-{n}", f"SELECT {n}", "mysql", f"SELECT {n}", None, None, "p", [], None, 9.0, 4.0, gain, "CONFIRMED", "1",
         NOW + datetime.timedelta(days=day), NOW + datetime.timedelta(days=day))
        for n in names
    ]
    return spark.createDataFrame(rows, CASE)


def content(df):
    return sorted(tuple(r) for r in df.select("fingerprint", "gain_ratio", "created_at", "updated_at").collect())


def test_upserts_equal_the_batch_result(spark, tmp_path):
    path = str(tmp_path / "backlog")
    assert backlog_store.read_backlog(spark, path).collect() == []
    first, second = cases(spark, range(40), 0), cases(spark, range(30, 50), 1, 0.9)
    backlog_store.upsert_cases(first, path, buckets=8)
    assert content(backlog_store.read_backlog(spark, path)) == content(first)
    # A run that breaks off after its rows are written, before they are published.
    backlog_store.stage_cases(cases(spark, range(100), 5, 0.1), path)
    assert content(backlog_store.read_backlog(spark, path)) == content(first)
    backlog_store.upsert_cases(second, path)
    assert content(backlog_store.read_backlog(spark, path)) == content(with_fresh_cases(second, first))
    found = {r.fingerprint: r for r in backlog_store.read_backlog(spark, path).collect()}
    assert found["SELECT 35"].created_at == NOW and found["SELECT 35"].gain_ratio == 0.9


def test_only_buckets_with_new_cases_are_written(spark, tmp_path):
    path = str(tmp_path / "backlog")
    backlog_store.upsert_cases(cases(spark, range(60), 0), path, buckets=16)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/rows/**/*.parquet", recursive=True)}
    backlog_store.upsert_cases(cases(spark, [3], 1, 0.7), path)
    written = glob.glob(f"{path}/rows/version=1/bucket=*")
    assert len(written) == 1
    assert all(os.path.getmtime(f) == t for f, t in before.items())
    held = backlog_store.manifest(spark, path).groupBy("held").count().collect()
    assert dict((r.held, r["count"]) for r in held)[1] == 1
    assert backlog_store.read_backlog(spark, path).count() == 60


def test_no_new_cases(spark, tmp_path):
    path = str(tmp_path / "backlog")
    backlog_store.upsert_cases(cases(spark, range(5), 0), path, buckets=4)
    backlog_store.upsert_cases(cases(spark, [], 1), path)
    assert backlog_store.read_backlog(spark, path).where(F.col("gain_ratio") == 0.5).count() == 5
