"""Streaming jobs over the given events, run until all input is taken."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide.fixtures import AS_OF, Tables
from sqltide.operators.filters import drop_blank_sql
from sqltide.registry.base import Entry, items_text, rounded
from sqltide.registry.collect import scratch, slow_columns
from sqltide.registry.oracle import sql
from sqltide.registry import analysis, collect
from sqltide.schemas import MYSQL_SLOW_LOG, PG_STAT_STATEMENTS, SLOW_QUERY
from sqltide.sources import ingest
from sqltide.streaming import jobs, sessions


def _log_files(t: Tables) -> str:
    """The slow log as extract files, as a collector leaves them."""
    path = scratch(t, "slow-log")
    log = t.mysql_log().withColumn("lock_time", F.make_dt_interval(secs=F.lit(0)))
    log.select(*MYSQL_SLOW_LOG.names).write.mode("overwrite").parquet(path)
    return path


def _query_files(t: Tables) -> str:
    path = scratch(t, "slow-queries")
    t.queries().select(*SLOW_QUERY.names).write.mode("overwrite").parquet(path)
    return path


def _finished(query) -> None:
    query.awaitTermination()


def _read(t: Tables, path: str, columns: str) -> DataFrame:
    return t.spark.read.schema(columns).parquet(path)


def _ingested(t: Tables) -> DataFrame:
    out = scratch(t, "ingested")
    rows = jobs.stream_ingest(t.spark, _log_files(t), F.col("user_host"), "labdb")
    _finished(jobs.to_files(rows, out, scratch(t, "progress")))
    return slow_columns(t.spark.read.schema(SLOW_QUERY).parquet(out))


def _unique(t: Tables) -> DataFrame:
    out = scratch(t, "unique")
    rows = jobs.stream_ingest(t.spark, _log_files(t), F.col("user_host"), "labdb")
    _finished(jobs.to_files(jobs.stream_dedup(rows, "60 days"), out, scratch(t, "progress")))
    return t.spark.read.schema(SLOW_QUERY).parquet(out).select(
        "source_db_host", "fingerprint", "sql_hash", "captured_at"
    )


def _into_store(t: Tables) -> DataFrame:
    """The slow log arrives twice, in several batches; every execution is stored once."""
    out, logs = scratch(t, "store"), _log_files(t)
    t.spark.read.schema(MYSQL_SLOW_LOG).parquet(logs).write.mode("append").parquet(logs)
    rows = jobs.stream_ingest(t.spark, logs, F.col("user_host"), "labdb", max_files=2)
    _finished(jobs.dedup_into_store(rows, out, scratch(t, "progress")))
    return t.spark.read.schema(SLOW_QUERY).parquet(out).select(
        "source_db_host", "fingerprint", "sql_hash", "captured_at"
    )


def _snapshots(t: Tables) -> DataFrame:
    """Statement statistics as a stream of snapshots into a store of patterns."""
    path, out = scratch(t, "snapshots"), scratch(t, "patterns")
    raw = t.pg_stat().withColumns(
        {"queryid": F.xxhash64("query"), "shared_blks_written": F.lit(0).cast("bigint")}
    )
    raw.select(*PG_STAT_STATEMENTS.names).write.mode("overwrite").parquet(path)
    rows = jobs.stream_snapshots(t.spark, path, "pg-1", "labdb", AS_OF)
    _finished(jobs.patterns_into_store(rows, out, scratch(t, "progress")))
    return t.spark.read.schema(SLOW_QUERY).parquet(out).select(
        "fingerprint", "full_sql", "plan_json", F.col("duration_ms").cast("double").alias("duration_ms")
    )


def _analyzed(t: Tables) -> DataFrame:
    out = scratch(t, "analyzed")
    rows = jobs.read_files(t.spark, _query_files(t), SLOW_QUERY)
    _finished(jobs.stream_analyze(rows, out, scratch(t, "progress"), AS_OF))
    return t.spark.read.parquet(out).select(
        "id", "slow_query_id", "problem", "root_cause", items_text().alias("suggestions"),
        "improvement_level", "estimated_speedup",
    )


def _trend(t: Tables) -> DataFrame:
    out = scratch(t, "trend")
    rows = jobs.read_files(t.spark, _query_files(t), SLOW_QUERY)
    trend = jobs.stream_trend(rows)
    _finished(jobs.to_files(trend, out, scratch(t, "progress")))
    stored = _read(
        t, out,
        "start timestamp_ntz, end timestamp_ntz, query_count bigint, avg_duration_ms double, max_duration_ms double",
    )
    return rounded(
        stored.select(
            F.to_date("start").alias("date"), "query_count",
            "avg_duration_ms", "max_duration_ms",
        ),
        "avg_duration_ms",
    )


def _history(t: Tables) -> DataFrame:
    out = scratch(t, "history")
    raw = jobs.read_files(t.spark, _log_files(t), MYSQL_SLOW_LOG)
    _finished(
        jobs.run_history(raw, drop_blank_sql, "mysql", "start_time", out, scratch(t, "progress"))
    )
    return _read(t, out, f"{jobs.RUN_HISTORY}, batch_id bigint").drop("ran_at")


def _reply_files(t: Tables) -> str:
    """Replies that arrive up to ten minutes before and forty after their query."""
    path = scratch(t, "replies")
    minutes = F.pmod(F.xxhash64("slow_query_id"), F.lit(50)) - 10
    captured = t.queries().select(F.col("id").alias("slow_query_id"), "captured_at")
    told = t.replies().join(captured, "slow_query_id").select(
        "slow_query_id", "reply", (F.col("captured_at") + F.make_dt_interval(mins=minutes.cast("int"))).alias("arrived_at")
    )
    told.write.mode("overwrite").parquet(path)
    return path


_HEARTBEAT = "2034-01-01 00:00:00"


def _answered(t: Tables) -> DataFrame:
    """Replies meet their queries on the stream; a late row of each side moves time on at the end."""
    queries, told, out = _query_files(t), _reply_files(t), scratch(t, "answered")
    beat = t.spark.read.schema(SLOW_QUERY).parquet(queries).limit(1)
    beat.withColumns({"id": F.lit("heartbeat"), "captured_at": F.lit(_HEARTBEAT).cast("timestamp_ntz")}).write.mode(
        "append"
    ).parquet(queries)
    schema = T.StructType().add("slow_query_id", "string").add("reply", "string").add("arrived_at", "timestamp_ntz")
    beat = t.spark.read.schema(schema).parquet(told).limit(1)
    beat.withColumns({"slow_query_id": F.lit("nobody"), "arrived_at": F.lit(_HEARTBEAT).cast("timestamp_ntz")}).write.mode(
        "append"
    ).parquet(told)
    rows, replies = jobs.read_files(t.spark, queries, SLOW_QUERY), jobs.read_files(t.spark, told, schema)
    _finished(jobs.stream_answered(rows, replies, out, scratch(t, "progress"), as_of=AS_OF))
    results = jobs.latest_results(t.spark.read.parquet(out)).where("slow_query_id <> 'heartbeat'")
    return analysis.answered_columns(results)


def _trend_so_far(t: Tables) -> DataFrame:
    """All days, those that a late row could still change as well."""
    out = scratch(t, "trend")
    rows = jobs.read_files(t.spark, _query_files(t), SLOW_QUERY)
    _finished(jobs.trend_into_store(rows, out, scratch(t, "progress")))
    stored = _read(
        t, out,
        "start timestamp_ntz, end timestamp_ntz, query_count bigint, avg_duration_ms double, max_duration_ms double, "
        "batch_id bigint",
    )
    return rounded(
        jobs.current_trend(stored).select(
            F.to_date("start").alias("date"), "query_count", "avg_duration_ms", "max_duration_ms"
        ),
        "avg_duration_ms",
    )


def _sessions(t: Tables) -> DataFrame:
    out = scratch(t, "sessions")
    rows = jobs.read_files(t.spark, _query_files(t), SLOW_QUERY, max_files=3)
    _finished(sessions.sessions_into_store(rows, out, scratch(t, "progress"), "10 minutes"))
    return rounded(sessions.stored_sessions(t.spark, out, "10 minutes"), "avg_duration_ms")


_SESSIONS_SQL = """
SELECT source_db_type, source_db_host, min(captured_at) AS start, max(captured_at) + INTERVAL 10 MINUTE AS end,
  count(*) AS query_count, round(CAST(sum(duration_ms) AS double) / count(duration_ms), 6) AS avg_duration_ms,
  CAST(max(duration_ms) AS double) AS max_duration_ms
FROM (SELECT *, sum(fresh) OVER (PARTITION BY source_db_type, source_db_host ORDER BY captured_at, id) AS session FROM (
  SELECT *, CASE WHEN captured_at <= lag(captured_at) OVER (PARTITION BY source_db_type, source_db_host
    ORDER BY captured_at, id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM q) f) s
GROUP BY source_db_type, source_db_host, session"""


def _histories(t: Tables) -> DataFrame:
    """Runs of three jobs: slow-log ingest, statement snapshots and analysis."""
    seen = jobs.RunHistory()
    t.spark.streams.addListener(seen)
    log = jobs.read_files(t.spark, _log_files(t), MYSQL_SLOW_LOG)
    kept = seen.watched("mysql", log, lambda raw: ingest.ingest_mysql_slow_log(raw, F.col("user_host"), "labdb"))
    _finished(jobs.to_files(kept, scratch(t, "ingested"), scratch(t, "progress")))
    path = scratch(t, "snapshots")
    raw = t.pg_stat().withColumns(
        {"queryid": F.xxhash64("query"), "shared_blks_written": F.lit(0).cast("bigint")}
    )
    raw.select(*PG_STAT_STATEMENTS.names).write.mode("overwrite").parquet(path)
    statements = jobs.read_files(t.spark, path, PG_STAT_STATEMENTS)
    kept = seen.watched("postgres", statements, lambda raw: ingest.ingest_pg_stat_statements(raw, "pg-1", "labdb", AS_OF))
    _finished(jobs.to_files(kept, scratch(t, "statements"), scratch(t, "progress")))
    queries = jobs.read_files(t.spark, _query_files(t), SLOW_QUERY)
    kept = seen.watched("analysis", queries, lambda raw: raw.where("status = 'NEW'"))
    _finished(jobs.stream_analyze(kept, scratch(t, "analyzed"), scratch(t, "progress")))
    for _ in range(300):  # progress arrives a moment after the end
        if len({job for job, _ in seen.runs}) == 3:
            break
        time.sleep(0.1)
    t.spark.streams.removeListener(seen)
    out = scratch(t, "history")
    seen.store(t.spark, out)
    kept = "rows_read bigint, rows_kept bigint, newest timestamp_ntz, began timestamp, run_ms bigint, job string, batch_id bigint"
    return _read(t, out, kept).where("run_ms > 0").drop("began", "run_ms")


ENTRIES: dict[str, Entry] = {
    "stream_ingest": Entry(
        _ingested, sql(collect.MYSQL_SQL, "mysql_log")
    ),
    "stream_dedup": Entry(
        _unique,
        sql(
            "SELECT DISTINCT source_db_host, fingerprint, sql_hash, captured_at "
            f"FROM ({collect.MYSQL_SQL}) i",
            "mysql_log",
        ),
    ),
    "dedup_into_store": Entry(
        _into_store,
        sql(
            "SELECT DISTINCT source_db_host, fingerprint, sql_hash, captured_at "
            f"FROM ({collect.MYSQL_SQL}) i",
            "mysql_log",
        ),
    ),
    "stream_snapshots": Entry(
        _snapshots,
        sql(
            "SELECT fingerprint, full_sql, plan_json, duration_ms FROM (SELECT *, row_number() OVER ("
            "PARTITION BY fingerprint ORDER BY duration_ms DESC, "
            "md5(concat_ws(chr(31), source_db_host, source_db_name, full_sql))) AS nth "
            f"FROM ({collect.PG_SQL}) p) r WHERE nth = 1",
            "pg_stat",
        ),
    ),
    "stream_analyze": Entry(
        _analyzed,
        sql(
            "SELECT md5(slow_query_id || '|1.0.0') AS id, slow_query_id, problem, root_cause, "
            "array_to_string(items, ';') AS suggestions, improvement_level, estimated_speedup "
            "FROM findings WHERE NOT analysis_failed",
            "findings",
        ),
    ),
    # Days that ended before the newest event less the allowed lateness.
    "stream_trend": Entry(
        _trend,
        sql(
            "SELECT CAST(captured_at AS date) AS date, count(*) AS query_count, "
            "round(CAST(sum(duration_ms) AS double) / count(*), 6) AS avg_duration_ms, "
            "CAST(max(duration_ms) AS double) AS max_duration_ms FROM q GROUP BY 1 "
            "HAVING CAST(captured_at AS date) + INTERVAL 1 DAY <= "
            "(SELECT max(captured_at) FROM q) - INTERVAL 1 DAY",
            "q",
        ),
    ),
    "run_history": Entry(
        _history,
        sql(
            "SELECT 'mysql' AS source, count(*) AS rows_read, "
            "count(*) FILTER (trim(coalesce(sql_text, '')) <> '') AS rows_kept, "
            "max(start_time) AS newest, CAST(0 AS bigint) AS batch_id FROM mysql_log",
            "mysql_log",
        ),
    ),
    "stream_answered": Entry(_answered, sql(analysis.MERGED_SQL, "findings", "replies")),
    "trend_into_store": Entry(
        _trend_so_far,
        sql(
            "SELECT CAST(captured_at AS date) AS date, count(*) AS query_count, "
            "round(CAST(sum(duration_ms) AS double) / count(*), 6) AS avg_duration_ms, "
            "CAST(max(duration_ms) AS double) AS max_duration_ms FROM q GROUP BY 1", "q",
        ),
    ),
    "stream_sessions": Entry(_sessions, sql(_SESSIONS_SQL, "q")),
    "run_history_jobs": Entry(
        _histories,
        sql(
            "SELECT 'mysql' AS job, CAST(0 AS bigint) AS batch_id, count(*) AS rows_read, "
            "count(*) FILTER (trim(coalesce(sql_text, '')) <> '') AS rows_kept, "
            "max(start_time) FILTER (trim(coalesce(sql_text, '')) <> '') AS newest FROM mysql_log "
            "UNION ALL SELECT 'postgres', 0, (SELECT count(*) FROM pg_stat), count(*), max(captured_at) "
            f"FROM ({collect.PG_SQL}) p "
            "UNION ALL SELECT 'analysis', 0, count(*), count(*) FILTER (status = 'NEW'), "
            "max(captured_at) FILTER (status = 'NEW') FROM q",
            "mysql_log", "pg_stat", "q",
        ),
    ),
}
