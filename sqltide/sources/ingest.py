"""Raw log extracts to slow-query rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide.functions import measures, text
from sqltide.operators.filters import (
    drop_blank_sql,
    exclude_internal,
    min_duration_filter,
    since_filter,
)
from sqltide.schemas import SLOW_QUERY


def with_fingerprint(df: DataFrame, column: str = "full_sql") -> DataFrame:
    """Adds ``fingerprint`` and ``sql_hash``, the md5 of the fingerprint."""
    return df.withColumn("fingerprint", text.normalize_query(F.col(column))).withColumn(
        "sql_hash", text.sql_hash(F.col("fingerprint"))
    )


def _row_id(*parts: Column) -> Column:
    """An id that depends on the row alone, so a re-run task gives the same one."""
    fields = [F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]
    return F.md5(F.concat_ws("\x1f", *fields).cast("binary"))


def _as_text(raw: DataFrame, column: str) -> DataFrame:
    if isinstance(raw.schema[column].dataType, T.BinaryType):
        return raw.withColumn(column, text.decode_bytes(F.col(column)))
    return raw


def plan_column(raw: DataFrame) -> Column:
    """The plan collected with a statement; a list of one plan is that plan."""
    if "plan_json" not in raw.columns:
        return F.lit(None).cast("string").alias("plan_json")
    plan = F.col("plan_json")
    only = F.get_json_object(plan, "$[0]").isNotNull() & F.get_json_object(plan, "$[1]").isNull()
    inside = F.regexp_extract(plan, r"(?s)\A\s*\[\s*(.*\S)\s*\]\s*\z", 1)
    return F.when(F.ltrim(plan).startswith("[") & only, inside).otherwise(plan).alias("plan_json")


def ingest_mysql_slow_log(
    raw: DataFrame,
    host: Column | str,
    default_db: str,
    since: str | datetime | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Slow-log rows to slow queries.

    ``host`` is a name, or a column when one extract holds several servers.
    ``limit`` keeps the newest rows only, before blank statements go.
    """
    raw = since_filter(_as_text(raw, "sql_text"), since)
    if limit is not None:
        raw = raw.orderBy(F.col("start_time").desc(), "sql_text").limit(limit)
    raw = drop_blank_sql(raw)
    host = F.lit(host) if isinstance(host, str) else host
    rows = raw.select(
        F.lit("mysql").alias("source_db_type"),
        host.alias("source_db_host"),
        F.coalesce(F.nullif(F.col("db"), F.lit("")), F.lit(default_db)).alias("source_db_name"),
        F.col("sql_text").alias("full_sql"),
        measures.interval_to_ms(F.col("query_time")).alias("duration_ms"),
        "rows_examined",
        F.col("rows_sent").alias("rows_returned"),
        plan_column(raw),
        F.col("start_time").alias("captured_at"),
        F.lit("NEW").alias("status"),
    )
    rows = with_fingerprint(rows)
    row_id = _row_id(
        F.col("source_db_host"), F.col("captured_at"), F.col("full_sql"), F.col("duration_ms"),
        F.col("source_db_name"), F.col("rows_examined"), F.col("rows_returned"),
    )
    return rows.withColumn("id", row_id).select(*SLOW_QUERY.names)


def ingest_pg_stat_statements(
    raw: DataFrame,
    host: Column | str,
    db: str,
    captured_at: Column | str | datetime,
    min_duration_ms: float = 1000.0,
    limit: int | None = None,
) -> DataFrame:
    """Statement statistics to slow queries, one per statement.

    ``captured_at`` is the time of the snapshot, or a column of the extract when
    it holds several.
    The duration is the mean; rows examined counts blocks read and hit.
    """
    raw = exclude_internal(min_duration_filter(_as_text(raw, "query"), min_duration_ms))
    if limit is not None:
        raw = raw.orderBy(F.col("mean_exec_time").desc(), "query").limit(limit)
    raw = drop_blank_sql(raw, "query")
    host = F.lit(host) if isinstance(host, str) else host
    rows = raw.select(
        F.lit("postgres").alias("source_db_type"),
        host.alias("source_db_host"),
        F.lit(db).alias("source_db_name"),
        F.col("query").alias("full_sql"),
        F.col("mean_exec_time").try_cast("decimal(18,3)").alias("duration_ms"),
        (
            F.coalesce("shared_blks_read", F.lit(0)) + F.coalesce("shared_blks_hit", F.lit(0))
        ).alias("rows_examined"),
        F.coalesce("rows", F.lit(0)).alias("rows_returned"),
        plan_column(raw),
        measures.at(captured_at).alias("captured_at"),
        F.lit("NEW").alias("status"),
    )
    rows = with_fingerprint(rows)
    row_id = _row_id(F.col("source_db_host"), F.col("source_db_name"), F.col("full_sql"))
    return rows.withColumn("id", row_id).select(*SLOW_QUERY.names)
