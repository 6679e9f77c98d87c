"""Ingest, sources, filters and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.fixtures import AS_OF, Tables
from sqltide.functions.measures import at
from sqltide.operators import dedup, filters
from sqltide.operators.knowledge import export_training_dataset, read_training_dataset
from sqltide.registry.base import Entry, analyses
from sqltide.registry.oracle import normalized, sql
from sqltide.registry.texts import anonymous_sql
from sqltide.schemas import SLOW_QUERY
from sqltide.sources import ingest, store

MID = "2024-01-15 00:00:00"


def scratch(t: Tables, name: str) -> str:
    """A new folder beside the cluster's checkpoints."""
    return store.new_folder(t.spark, name)


def slow_columns(df: DataFrame) -> DataFrame:
    """Comparable columns of ingested rows; ids are checked by the tests."""
    return df.select(
        "source_db_type", "source_db_host", "source_db_name", "fingerprint", "full_sql", "sql_hash",
        F.col("duration_ms").cast("double").alias("duration_ms"), "rows_examined", "rows_returned",
        "plan_json", "captured_at", "status",
    )


def ingested_log(t: Tables, since: str | None = None) -> DataFrame:
    return ingest.ingest_mysql_slow_log(t.mysql_log(), F.col("user_host"), "labdb", since)


MYSQL_SQL = f"""
SELECT 'mysql' AS source_db_type, user_host AS source_db_host,
  coalesce(nullif(db, ''), 'labdb') AS source_db_name, {normalized('sql_text')} AS fingerprint,
  sql_text AS full_sql, md5({normalized('sql_text')}) AS sql_hash,
  CAST(query_ms AS double) AS duration_ms, rows_examined, rows_sent AS rows_returned, plan_json,
  start_time AS captured_at, 'NEW' AS status
FROM mysql_log WHERE trim(coalesce(sql_text, '')) <> ''"""

PG_SQL = f"""
SELECT 'postgres' AS source_db_type, 'pg-1' AS source_db_host, 'labdb' AS source_db_name,
  {normalized('query')} AS fingerprint, query AS full_sql, md5({normalized('query')}) AS sql_hash,
  CAST(CAST(mean_exec_time AS decimal(18,3)) AS double) AS duration_ms,
  shared_blks_read + shared_blks_hit AS rows_examined, rows AS rows_returned,
  substr(plan_json, 2, length(plan_json) - 2) AS plan_json, TIMESTAMP '{AS_OF}' AS captured_at, 'NEW' AS status
FROM pg_stat WHERE mean_exec_time >= 1000 AND query NOT ILIKE '%pg_stat_statements%'
  AND query NOT ILIKE '%pg_catalog%'"""


def _loaded(t: Tables) -> DataFrame:
    """Slow queries written and read back as JSON lines with the declared schema."""
    path = scratch(t, "extract")
    t.queries().select(*SLOW_QUERY.names).write.mode("overwrite").option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).json(path)
    loaded = store.load_slow_queries(t.spark, path, "json", SLOW_QUERY)
    return loaded.select(
        "id", "full_sql", F.col("duration_ms").cast("double").alias("duration_ms"), "rows_examined",
        "plan_json", "captured_at", "status",
        F.col(store.CORRUPT).isNotNull().alias("corrupt"),
    )


def _written(t: Tables) -> DataFrame:
    """Two batches, the second of them written twice: nothing doubles."""
    path = scratch(t, "results")
    q = t.queries().select("id", "status", "captured_at")
    first = q.where(F.col("captured_at") < at(MID)).withColumn("batch_id", F.lit(1))
    second = q.where(F.col("captured_at") >= at(MID)).withColumn("batch_id", F.lit(2))
    for batch in (first, second, second):
        store.write_results(batch, path)
    return t.spark.read.schema("id string, status string, captured_at timestamp_ntz, batch_id int").parquet(path)


def _exported(t: Tables) -> DataFrame:
    """The export, written as JSON lines and read back."""
    path = scratch(t, "training")
    export_training_dataset(t.cases(), path)
    rows = read_training_dataset(t.spark, path)
    return rows.select("input.*", "output.suggestion", F.round("output.gain_ratio", 6).alias("gain_ratio"))


# The plan's one table is no table of the statement: every name in it is its own.
_EXPORT = f"""
SELECT db_type, anonymous AS fingerprint, replace(plan_json, '"brand"', '"name_1"') AS plan_json,
  CAST(NULL AS varchar) AS schema_context, 'fix ' || c.id AS suggestion, round(gain_ratio, 6) AS gain_ratio
FROM cases c JOIN ({anonymous_sql('fingerprint', 'cases', 'id')}) f ON f.id = c.id
WHERE effectiveness = 'CONFIRMED' AND gain_ratio >= 0.3"""


def _detail(t: Tables) -> DataFrame:
    """The detail of the first query by id."""
    first = t.queries().agg(F.min("id")).first()[0]
    detail = filters.query_detail(t.queries(), analyses(t), first)
    return detail.select(
        "id", "fingerprint", "status", F.col("analysis.problem").alias("problem"),
        F.col("analysis.improvement_level").alias("improvement_level"),
    )


CLICK = "SELECT * FROM orders WHERE user_id = ? AND status = ? LIMIT ?"


def _deleted(t: Tables) -> DataFrame:
    """Old queries go; what is left of both tables, stacked."""
    gone = t.queries().where(F.col("captured_at") < at(MID)).select("id")
    q, a = filters.delete_queries(t.queries(), analyses(t), gone)
    return q.select(F.lit("query").alias("kind"), "id").unionByName(
        a.select(F.lit("analysis").alias("kind"), F.col("slow_query_id").alias("id"))
    )


def _store(t: Tables) -> DataFrame:
    return t.queries().where(F.col("captured_at") < at(MID))


def _new_executions(t: Tables) -> DataFrame:
    q = t.queries()
    twice = q.unionByName(q.withColumn("id", F.concat(F.col("id"), F.lit("-copy"))))
    fresh = dedup.dedup_executions(twice, _store(t))
    return fresh.select("id", "source_db_type", "source_db_host", "sql_hash", "captured_at")


def _new_patterns(t: Tables) -> DataFrame:
    stored = _store(t).where(F.col("source_db_host").isin("host-0", "host-1"))
    fresh = dedup.dedup_patterns(t.queries(), stored)
    return fresh.select(
        "id", "source_db_type", "source_db_host", "fingerprint",
        F.col("duration_ms").cast("double").alias("duration_ms"),
    )


ENTRIES: dict[str, Entry] = {
    "ingest_mysql_slow_log": Entry(lambda t: slow_columns(ingested_log(t)), sql(MYSQL_SQL, "mysql_log")),
    "ingest_pg_stat_statements": Entry(
        lambda t: slow_columns(
            ingest.ingest_pg_stat_statements(t.pg_stat(), "pg-1", "labdb", AS_OF)
        ),
        sql(PG_SQL, "pg_stat"),
    ),
    "load_slow_queries": Entry(
        _loaded,
        sql(
            "SELECT id, full_sql, CAST(duration_ms AS double) AS duration_ms, rows_examined, plan_json, "
            "captured_at, status, false AS corrupt FROM q",
            "q",
        ),
    ),
    "write_results": Entry(
        _written,
        sql(
            f"SELECT id, status, captured_at, CASE WHEN captured_at < TIMESTAMP '{MID}' THEN 1 ELSE 2 END "
            "AS batch_id FROM q",
            "q",
        ),
    ),
    "export_training_dataset": Entry(_exported, sql(_EXPORT, "cases")),
    "latest_db_metadata": Entry(
        lambda t: store.latest_db_metadata(t.metadata()).withColumn(
            "indexes", F.array_join("indexes", ",")
        ),
        sql("SELECT * FROM meta_tables", "meta_tables"),
    ),
    "since_filter": Entry(
        lambda t: filters.since_filter(t.mysql_log(), MID).groupBy("user_host").agg(
            F.count(F.lit(1)).alias("n"), F.min("start_time").alias("oldest")
        ),
        sql(
            f"SELECT user_host, count(*) AS n, min(start_time) AS oldest FROM mysql_log "
            f"WHERE start_time > TIMESTAMP '{MID}' GROUP BY user_host",
            "mysql_log",
        ),
    ),
    "min_duration_filter": Entry(
        lambda t: filters.min_duration_filter(t.pg_stat(), 20000).select("query", "calls"),
        sql("SELECT query, calls FROM pg_stat WHERE mean_exec_time >= 20000", "pg_stat"),
    ),
    "exclude_internal": Entry(
        lambda t: filters.exclude_internal(t.pg_stat()).select("query", "calls"),
        sql(
            "SELECT query, calls FROM pg_stat WHERE query NOT ILIKE '%pg_stat_statements%' "
            "AND query NOT ILIKE '%pg_catalog%'",
            "pg_stat",
        ),
    ),
    "drop_blank_sql": Entry(
        lambda t: filters.drop_blank_sql(t.mysql_log()).select("start_time", "user_host", "sql_text"),
        sql(
            "SELECT start_time, user_host, sql_text FROM mysql_log "
            "WHERE sql_text IS NOT NULL AND trim(sql_text) <> ''",
            "mysql_log",
        ),
    ),
    "filter_queries": Entry(
        lambda t: filters.filter_queries(t.queries(), "mysql", "host-1", "NEW").select("id", "fingerprint"),
        sql(
            "SELECT id, fingerprint FROM q WHERE source_db_type = 'mysql' AND source_db_host = 'host-1' "
            "AND status = 'NEW'",
            "q",
        ),
    ),
    "search_sql": Entry(
        lambda t: filters.search_sql(t.queries(), "TEST:SCAN-002").select("id", "full_sql"),
        sql("SELECT id, full_sql FROM q WHERE contains(full_sql, 'TEST:SCAN-002')", "q"),
    ),
    "query_detail": Entry(
        _detail,
        sql(
            "SELECT q.id, fingerprint, status, problem, improvement_level FROM q "
            "LEFT JOIN a ON a.slow_query_id = q.id WHERE q.id = (SELECT min(id) FROM q)",
            "q", "a",
        ),
    ),
    "by_fingerprint": Entry(
        lambda t: filters.by_fingerprint(t.queries(), CLICK).select("id", "captured_at", "full_sql"),
        sql(
            f"SELECT id, captured_at, full_sql FROM q WHERE fingerprint = '{CLICK}' "
            "ORDER BY captured_at DESC, id LIMIT 10",
            "q",
        ),
    ),
    "delete_queries": Entry(
        _deleted,
        sql(
            f"SELECT 'query' AS kind, id FROM q WHERE captured_at >= TIMESTAMP '{MID}' UNION ALL "
            f"SELECT 'analysis', slow_query_id FROM a JOIN q ON q.id = slow_query_id "
            f"WHERE captured_at >= TIMESTAMP '{MID}'",
            "q", "a",
        ),
    ),
    "list_cases": Entry(
        lambda t: filters.list_cases(t.cases(), "mysql", "CONFIRMED", 0.4).select("id", "fingerprint"),
        sql(
            "SELECT id, fingerprint FROM cases WHERE db_type = 'mysql' AND effectiveness = 'CONFIRMED' "
            "AND gain_ratio >= 0.4",
            "cases",
        ),
    ),
    "pending_batch": Entry(
        lambda t: filters.pending_batch(t.queries(), 50).select("id", "captured_at"),
        sql(
            "SELECT id, captured_at FROM q WHERE status = 'NEW' ORDER BY captured_at, id LIMIT 50", "q"
        ),
    ),
    "dedup_executions": Entry(
        _new_executions,
        sql(
            "SELECT min(id) AS id, source_db_type, source_db_host, sql_hash, captured_at FROM q "
            f"WHERE captured_at >= TIMESTAMP '{MID}' "
            "GROUP BY source_db_type, source_db_host, sql_hash, captured_at",
            "q",
        ),
    ),
    "dedup_patterns": Entry(
        _new_patterns,
        sql(
            "SELECT id, source_db_type, source_db_host, fingerprint, CAST(duration_ms AS double) AS duration_ms "
            "FROM (SELECT *, row_number() OVER (PARTITION BY source_db_type, source_db_host, fingerprint "
            "ORDER BY duration_ms DESC, id) AS nth FROM q) r WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM q s "
            f"WHERE s.captured_at < TIMESTAMP '{MID}' AND s.source_db_host IN ('host-0', 'host-1') "
            "AND s.source_db_type = r.source_db_type AND s.source_db_host = r.source_db_host "
            "AND s.fingerprint = r.fingerprint)",
            "q",
        ),
    ),
}
