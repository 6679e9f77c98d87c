"""Declared schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

SUGGESTION = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("type", "priority", "description", "sql", "estimated_impact", "rationale")
    ]
)

MYSQL_SLOW_LOG = T.StructType(
    [
        T.StructField("start_time", T.TimestampNTZType()),
        T.StructField("user_host", T.StringType()),
        T.StructField("query_time", T.DayTimeIntervalType()),
        T.StructField("lock_time", T.DayTimeIntervalType()),
        T.StructField("rows_sent", T.LongType()),
        T.StructField("rows_examined", T.LongType()),
        T.StructField("db", T.StringType()),
        T.StructField("sql_text", T.StringType()),
        T.StructField("plan_json", T.StringType()),
    ]
)

PG_STAT_STATEMENTS = T.StructType(
    [
        T.StructField("queryid", T.LongType()),
        T.StructField("query", T.StringType()),
        T.StructField("calls", T.LongType()),
        T.StructField("total_exec_time", T.DoubleType()),
        T.StructField("mean_exec_time", T.DoubleType()),
        T.StructField("max_exec_time", T.DoubleType()),
        T.StructField("rows", T.LongType()),
        T.StructField("shared_blks_hit", T.LongType()),
        T.StructField("shared_blks_read", T.LongType()),
        T.StructField("shared_blks_written", T.LongType()),
        T.StructField("plan_json", T.StringType()),
    ]
)

SLOW_QUERY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_db_type", T.StringType()),
        T.StructField("source_db_host", T.StringType()),
        T.StructField("source_db_name", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("full_sql", T.StringType()),
        T.StructField("sql_hash", T.StringType()),
        T.StructField("duration_ms", T.DecimalType(18, 3)),
        T.StructField("rows_examined", T.LongType()),
        T.StructField("rows_returned", T.LongType()),
        T.StructField("plan_json", T.StringType()),
        T.StructField("captured_at", T.TimestampNTZType()),
        T.StructField("status", T.StringType()),
    ]
)

ANALYSIS_METADATA = T.StructType(
    [
        T.StructField("tables", T.ArrayType(T.StringType())),
        T.StructField("ai_insights", T.ArrayType(T.StringType())),
        T.StructField("ai_provider", T.StringType()),
        T.StructField("ai_model", T.StringType()),
    ]
)

DB_METADATA = T.StructType(
    [
        T.StructField("source_db_type", T.StringType()),
        T.StructField("source_db_host", T.StringType()),
        T.StructField("source_db_name", T.StringType()),
        T.StructField("captured_at", T.TimestampNTZType()),
        T.StructField(
            "tables",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("row_count", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "indexes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("table", T.StringType()),
                        T.StructField("name", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("slow_query_fingerprint", T.StringType()),
        T.StructField("analysis_result_id", T.StringType()),
        T.StructField("old_duration_ms", T.DoubleType()),
        T.StructField("new_duration_ms", T.DoubleType()),
        T.StructField("gain_ratio", T.DoubleType()),
        T.StructField("checked_at", T.TimestampNTZType()),
    ]
)

# The columns of a knowledge case.
CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("db_type", T.StringType()),
        T.StructField("full_sql", T.StringType()),
        T.StructField("plan_json", T.StringType()),
        T.StructField("schema_context", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("suggestions", T.ArrayType(SUGGESTION)),
        T.StructField("applied_fix", T.StringType()),
        T.StructField("old_duration_ms", T.DoubleType()),
        T.StructField("new_duration_ms", T.DoubleType()),
        T.StructField("gain_ratio", T.DoubleType()),
        T.StructField("effectiveness", T.StringType()),
        T.StructField("analyzer_version", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)
