"""Sessions kept in pieces, replies that arrive later, snapshot times and run history."""

from __future__ import annotations

import datetime
import random
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from sqltide.fixtures import AS_OF, Tables
from sqltide.plans import analysis
from sqltide.plans.replies import parse_ai_replies
from sqltide.schemas import MYSQL_SLOW_LOG, PG_STAT_STATEMENTS, SLOW_QUERY
from sqltide.sources import ingest
from sqltide.streaming import jobs, sessions

START = datetime.datetime(2024, 1, 1)
SECOND = datetime.timedelta(seconds=1)


def slow_queries(spark, values):
    """(id, host, time, duration, sql) in the declared columns."""
    df = spark.createDataFrame(
        values, "id string, source_db_host string, captured_at timestamp_ntz, ms int, full_sql string"
    )
    df = df.withColumns({"duration_ms": F.col("ms").cast("decimal(18,3)"), "source_db_type": F.lit("mysql")})
    for field in SLOW_QUERY.fields:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*SLOW_QUERY.names)


def plain_sessions(values, gap):
    out = {}
    for _, host, at, ms, _ in sorted(values, key=lambda v: (str(v[1]), v[2])):
        held = out.setdefault(host, [])
        if held and at <= held[-1][1] + gap:
            held[-1][1] = at
            held[-1][2].append(ms)
        else:
            held.append([at, at, [ms]])
    return sorted(
        (str(host), a, b + gap, len(ms), max((m for m in ms if m is not None), default=None))
        for host, held in out.items() for a, b, ms in held
    )


def test_sessions_of_a_hot_source(spark, tmp_path):
    """One source has nearly all rows; sessions lie inside pieces, across them and over several."""
    draw, values, at = random.Random(1), [], START
    for i in range(2500):
        at += draw.choice([1, 5, 20, 59, 60, 61, 300, 4000]) * SECOND if i % 40 else 9000 * SECOND
        values.append((str(i), "hot", at, draw.choice([None, 3, 70]), "SELECT 1"))
    values += [(f"c{i}", h, START + i * 50 * SECOND, i, "SELECT 1") for i in range(200) for h in ("cold", None)]
    draw.shuffle(values)
    source, out = str(tmp_path / "q"), str(tmp_path / "s")
    for n in range(4):
        slow_queries(spark, values[n::4]).coalesce(1).write.mode("append").parquet(source)
    rows = jobs.read_files(spark, source, SLOW_QUERY, max_files=1)
    sessions.sessions_into_store(rows, out, str(tmp_path / "c"), "1 minute", piece="10 minutes").awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.select("batch_id").distinct().count() == 4
    assert stored.where("source_db_host = 'hot'").select("piece").distinct().count() > 100
    found = sessions.stored_sessions(spark, out, "1 minute")
    got = sorted((str(r.source_db_host), r.start, r.end, r.query_count, r.max_duration_ms) for r in found.collect())
    assert got == plain_sessions(values, 60 * SECOND)


def test_sessions_equal_those_of_spark(spark):
    draw = random.Random(2)
    values = [(str(i), "h", START + draw.randrange(40_000) * SECOND, 1, "s") for i in range(600)]
    rows = slow_queries(spark, values)
    timed = rows.withColumn("at", jobs.to_instant(F.col("captured_at")))
    own = timed.groupBy(F.session_window("at", "45 seconds").alias("w"), "source_db_host").count()
    own = sorted((jobs_naive, n) for jobs_naive, n in (
        (r.s, r["count"]) for r in own.select(jobs.to_naive(F.col("w.start")).alias("s"), "count").collect()
    ))
    parts = sessions.partial_sessions(rows, "45 seconds", piece="5 minutes")
    found = sorted((r.start, r.query_count) for r in sessions.merged_sessions(parts, "45 seconds").collect())
    assert found == own


def test_replies_early_late_and_none(spark, tmp_path):
    minute = 60 * SECOND
    values = [(f"q{i}", "h", START + i * minute, 9000, "SELECT * FROM t WHERE a = 1") for i in range(6)]
    told = [
        ("q0", '{"root_cause": "early", "confidence": 0.9}', START - 5 * minute),
        ("q1", '{"root_cause": "late", "confidence": 0.9}', START + 31 * minute),
        ("q2", '{"root_cause": "too late", "confidence": 0.9}', START + 100 * minute),
        ("q3", "no JSON at all", START + 4 * minute),
        ("q4", '{"root_cause": "worse", "confidence": 0.5}', START + 5 * minute),
        ("q4", '{"root_cause": "better", "confidence": 0.95}', START + 6 * minute),
    ]
    beat = START + datetime.timedelta(days=2)
    queries, replies, out = str(tmp_path / "q"), str(tmp_path / "r"), str(tmp_path / "out")
    schema = T.StructType().add("slow_query_id", "string").add("reply", "string").add("arrived_at", "timestamp_ntz")
    for part in (values, [("beat", "h", beat, 1, "SELECT 1")]):
        slow_queries(spark, part).coalesce(1).write.mode("append").parquet(queries)
    for part in (told[:2], told[2:], [("nobody", "x", beat)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(replies)
    jobs.stream_answered(
        jobs.read_files(spark, queries, SLOW_QUERY), jobs.read_files(spark, replies, schema), out, str(tmp_path / "c"),
        as_of=AS_OF,
    ).awaitTermination()
    got = {r.slow_query_id: r for r in jobs.latest_results(spark.read.parquet(out)).collect()}
    assert {k: got[k].root_cause for k in ("q0", "q1", "q4")} == {"q0": "early", "q1": "late", "q4": "better"}
    assert got["q2"].analysis_method == got["q5"].analysis_method == "rule_based"
    assert got["q3"].analysis_method == "hybrid"
    in_time = [t for t in told if t[1] != told[2][1]]
    parsed = parse_ai_replies(spark.createDataFrame(in_time, schema))
    batch = analysis.analyze(slow_queries(spark, values), AS_OF, replies=parsed)
    columns = ["id", "problem", "root_cause", "suggestions", "improvement_level", "analysis_method", "analysis_metadata"]
    want = sorted(map(repr, batch.select(*columns).collect()))
    stored = jobs.latest_results(spark.read.parquet(out)).where("slow_query_id <> 'beat'")
    assert sorted(map(repr, stored.select(*columns).collect())) == want


def test_replies_over_several_batches(spark, tmp_path):
    """Each side comes by one file a batch; what waits for the other side is in no streaming state."""
    minute, hour = 60 * SECOND, 3600 * SECOND
    sql = "SELECT * FROM t WHERE a = 1"
    schema = T.StructType().add("slow_query_id", "string").add("reply", "string").add("arrived_at", "timestamp_ntz")
    said = lambda q, cause, at, sure=0.9: (q, f'{{"root_cause": "{cause}", "confidence": {sure}}}', START + at)
    asked = [
        [(q, "h", START + i * minute, 9000, sql) for i, q in enumerate(["same", "next", "twice", "never", "null", "late"])],
        [("early", "h", START + 20 * minute, 9000, sql), ("same", "h", START, 9000, sql)],
        [("move", "h", START + 5 * hour, 9000, sql)],
        [("old", "h", START + minute, 9000, sql), ("open", "h", START + 5 * hour, 9000, sql)],
        [("move2", "h", START + 9 * hour, 9000, sql)],
    ]
    told = [
        [said("same", "a", minute), said("twice", "worse", minute, 0.5), said("early", "b", minute), ("null", None, START)],
        [said("next", "c", 30 * minute), said("twice", "better", 9 * minute, 0.95), said("never", "no", 3 * hour)],
        [("nobody", "x", START + 5 * hour)],
        [said("late", "too late", 2 * minute), said("old", "d", minute)],
        [("nobody", "x", START + 9 * hour)],
    ]
    queries, replies, out = str(tmp_path / "q"), str(tmp_path / "r"), str(tmp_path / "out")
    for part, answers in zip(asked, told, strict=True):
        slow_queries(spark, part).coalesce(1).write.mode("append").parquet(queries)
        spark.createDataFrame(answers, schema).coalesce(1).write.mode("append").parquet(replies)
    run = jobs.stream_answered(
        jobs.read_files(spark, queries, SLOW_QUERY, max_files=1), jobs.read_files(spark, replies, schema, max_files=1),
        out, str(tmp_path / "c"), as_of=AS_OF,
    )
    run.awaitTermination()
    assert [p.stateOperators for p in run.recentProgress if p.stateOperators] == []
    stored = spark.read.parquet(out)
    got = {r.slow_query_id: r.root_cause for r in jobs.latest_results(stored).collect()}
    own = got["never"]
    assert got == {
        "same": "a", "next": "c", "twice": "better", "never": own, "null": own, "late": own, "early": "b", "move": own, "open": own,
    }
    # A query that was answered is not told of again when its time is over.
    assert {r.slow_query_id: r["count"] for r in stored.groupBy("slow_query_id").count().collect() if r["count"] > 1} == {
        "same": 2, "twice": 2
    }


def statement(i, at=None):
    return (i, f"SELECT c{i} FROM t", 1, 1.0, 5000.0, 1.0, 1, 1, 1, 0, None, at)


def test_snapshots_keep_their_times(spark, tmp_path):
    schema = T.StructType([*PG_STAT_STATEMENTS.fields, T.StructField("captured_at", T.TimestampNTZType())])
    source, out = str(tmp_path / "s"), str(tmp_path / "p")
    times = [START, START + 3600 * SECOND]
    for i, at in enumerate(times):
        spark.createDataFrame([statement(i, at)], schema).coalesce(1).write.mode("append").parquet(source)
    # An extract without times has that of its file.
    spark.createDataFrame([statement(9)], schema).drop("captured_at").coalesce(1).write.mode("append").parquet(source)
    rows = jobs.stream_snapshots(spark, source, "h", "d", max_files=1)
    jobs.patterns_into_store(rows, out, str(tmp_path / "c")).awaitTermination()
    got = {r.full_sql: r.captured_at for r in spark.read.schema(SLOW_QUERY).parquet(out).collect()}
    assert [got[f"SELECT c{i} FROM t"] for i in range(2)] == times
    assert abs((got["SELECT c9 FROM t"] - datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)).days) <= 1
    # The same statements again add nothing.
    spark.createDataFrame([statement(0, times[1])], schema).coalesce(1).write.mode("append").parquet(source)
    rows = jobs.stream_snapshots(spark, source, "h", "d", max_files=1)
    jobs.patterns_into_store(rows, out, str(tmp_path / "c")).awaitTermination()
    assert spark.read.schema(SLOW_QUERY).parquet(out).count() == 3


def test_history_of_a_job(spark, tmp_path):
    source = str(tmp_path / "log")
    log = Tables(spark, SMALL).mysql_log().withColumn("lock_time", F.make_dt_interval(secs=F.lit(0)))
    log.select(*MYSQL_SLOW_LOG.names).repartition(3).write.parquet(source)
    seen = jobs.RunHistory()
    spark.streams.addListener(seen)
    raw = jobs.read_files(spark, source, MYSQL_SLOW_LOG, max_files=1)
    kept = seen.watched("log", raw, lambda rows: ingest.ingest_mysql_slow_log(rows, "h", "d"))
    jobs.to_files(kept, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    for _ in range(100):
        if len(seen.runs) == 3:
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    for _ in range(2):  # stored twice, there once
        seen.store(spark, str(tmp_path / "history"))
    runs = spark.read.parquet(str(tmp_path / "history"))
    total = runs.agg(F.count("*"), F.sum("rows_read"), F.sum("rows_kept"), F.min("run_ms"), F.max("newest")).first()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert total[:3] == (3, log.count(), stored.count()) and total[3] > 0
    assert total[4] == stored.agg(F.max("captured_at")).first()[0]


def test_all_windows_are_there_at_the_end(spark, tmp_path):
    source, out = str(tmp_path / "q"), str(tmp_path / "t")
    day = datetime.timedelta(days=1)
    for n in range(3):
        slow_queries(spark, [(f"{n}-{i}", "h", START + n * day + i * SECOND, i, "s") for i in range(4)]).coalesce(1).write.mode(
            "append"
        ).parquet(source)
    slow_queries(spark, [("again", "h", START + 2 * day, 50, "s")]).coalesce(1).write.mode("append").parquet(source)
    rows = jobs.read_files(spark, source, SLOW_QUERY, max_files=1)
    jobs.trend_into_store(rows, out, str(tmp_path / "c")).awaitTermination()
    got = jobs.current_trend(spark.read.parquet(out)).orderBy("start").collect()
    assert [(r.query_count, r.max_duration_ms) for r in got] == [(4, 3.0), (4, 3.0), (5, 50.0)]
