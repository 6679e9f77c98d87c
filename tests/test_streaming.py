"""Streams against the batch results over the same files."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import functions as F

from conftest import SMALL
from sqltide.fixtures import AS_OF, Tables
from sqltide.operators.dedup import EXECUTION_KEY, dedup_executions
from sqltide.operators.filters import drop_blank_sql
from sqltide.plans.analysis import analyze
from sqltide.schemas import MYSQL_SLOW_LOG, SLOW_QUERY
from sqltide.sources.ingest import ingest_mysql_slow_log
from sqltide.streaming import jobs

KEY = list(EXECUTION_KEY)


def write_days(spark, path):
    """The slow log as one file per day, in order of time."""
    log = Tables(spark, SMALL).mysql_log().withColumn("lock_time", F.make_dt_interval(secs=F.lit(0)))
    log = log.select(*MYSQL_SLOW_LOG.names).cache()
    days = [r[0] for r in log.select(F.to_date("start_time").alias("d")).distinct().orderBy("d").collect()]
    for day in days[:6]:
        log.where(F.to_date("start_time") == F.lit(day)).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(MYSQL_SLOW_LOG).parquet(path)


def stored_queries(spark, path):
    q = Tables(spark, SMALL).queries().select(*SLOW_QUERY.names)
    q.repartition(4).write.parquet(path)
    return spark.read.schema(SLOW_QUERY).parquet(path)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_ingest_and_dedup_equal_batch(spark, tmp_path):
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    raw = write_days(spark, source)
    batch = ingest_mysql_slow_log(raw, "h", "d")
    stream = jobs.stream_ingest(spark, source, "h", "d", max_files=2)
    jobs.to_files(stream, out, str(tmp_path / "c1")).awaitTermination()
    assert rows(spark.read.schema(SLOW_QUERY).parquet(out)) == rows(batch)

    unique = dedup_executions(batch, spark.createDataFrame([], SLOW_QUERY)).select(*KEY)
    assert unique.count() < batch.count()
    stream = jobs.stream_dedup(jobs.stream_ingest(spark, source, "h", "d", max_files=2), "30 days")
    jobs.to_files(stream, str(tmp_path / "u"), str(tmp_path / "c2")).awaitTermination()
    assert rows(spark.read.schema(SLOW_QUERY).parquet(str(tmp_path / "u")).select(*KEY)) == rows(unique)

    # against the stored table, with no bound on how old a duplicate may be
    stream = jobs.stream_ingest(spark, source, "h", "d", max_files=1)
    table = str(tmp_path / "t")
    jobs.dedup_into_store(stream, table, str(tmp_path / "c3")).awaitTermination()
    assert rows(spark.read.parquet(table).select(*KEY)) == rows(unique)


def test_analysis_is_stored_once_when_a_batch_runs_again(spark, tmp_path):
    source, out = str(tmp_path / "q"), str(tmp_path / "a")
    q = stored_queries(spark, source)
    stream = jobs.read_files(spark, source, SLOW_QUERY, max_files=2)
    jobs.stream_analyze(stream, out, str(tmp_path / "c"), AS_OF).awaitTermination()
    want = rows(analyze(q, AS_OF).select("id", "problem"))
    assert rows(spark.read.parquet(out).select("id", "problem")) == want
    # the same batch ids again: a new checkpoint replays them into the same table
    stream = jobs.read_files(spark, source, SLOW_QUERY, max_files=2)
    jobs.stream_analyze(stream, out, str(tmp_path / "c2"), AS_OF).awaitTermination()
    assert rows(spark.read.parquet(out).select("id", "problem")) == want


def test_trend_windows_and_late_rows(spark, tmp_path):
    source, out = str(tmp_path / "q"), str(tmp_path / "trend")
    start = datetime.datetime(2024, 1, 1, 1)
    day = datetime.timedelta(days=1)
    for n, days in enumerate(([0, 0, 1], [3], [3], [0], [9])):  # the fourth is late
        values = [(f"{n}-{i}", start + d * day) for i, d in enumerate(days)]
        df = spark.createDataFrame(values, "id string, captured_at timestamp_ntz")
        for field in SLOW_QUERY.fields:
            if field.name not in df.columns:
                value = F.lit(10) if field.name == "duration_ms" else F.lit(None)
                df = df.withColumn(field.name, value.cast(field.dataType))
        df.select(*SLOW_QUERY.names).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_files(spark, source, SLOW_QUERY, max_files=1)
    late = jobs.LateRows()
    spark.streams.addListener(late)
    query = jobs.to_files(jobs.stream_trend(stream), out, str(tmp_path / "c"))
    query.awaitTermination()
    got = {
        r.start.day: r.query_count
        for r in spark.read.schema(
            "start timestamp_ntz, end timestamp_ntz, query_count long"
        ).parquet(out).collect()
    }
    assert got == {1: 2, 2: 1, 4: 2}
    for _ in range(100):
        if late.of(query):
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    assert late.of(query) == 1


def test_sliding_and_session_windows(spark, tmp_path):
    source = str(tmp_path / "q")
    stored_queries(spark, source)
    for name, options in (
        ("slide", {"window": "2 days", "slide": "1 day"}),
        ("session", {"session_gap": "1 hour"}),
    ):
        stream = jobs.read_files(spark, source, SLOW_QUERY)
        out = str(tmp_path / name)
        trend = jobs.stream_trend(stream, late_by="1 hour", **options)
        jobs.to_files(trend, out, str(tmp_path / f"c-{name}")).awaitTermination()
        assert spark.read.parquet(out).count() > 0


def test_run_history(spark, tmp_path):
    source, out = str(tmp_path / "log"), str(tmp_path / "runs")
    raw = write_days(spark, source)
    stream = jobs.read_files(spark, source, MYSQL_SLOW_LOG, max_files=3)
    jobs.run_history(
        stream, drop_blank_sql, "mysql", "start_time", out, str(tmp_path / "c")
    ).awaitTermination()
    runs = spark.read.parquet(out)
    assert runs.count() >= 2
    total = runs.agg(F.sum("rows_read"), F.sum("rows_kept")).first()
    assert tuple(total) == (raw.count(), drop_blank_sql(raw).count())
