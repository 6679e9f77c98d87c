"""Filters over raw log rows and stored slow queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.functions.measures import at


def since_filter(
    raw: DataFrame, since: str | datetime | None, column: str = "start_time"
) -> DataFrame:
    """Rows strictly newer than ``since``; all rows when it is None."""
    return raw if since is None else raw.where(F.col(column) > at(since))


def min_duration_filter(raw: DataFrame, ms: float, column: str = "mean_exec_time") -> DataFrame:
    return raw.where(F.col(column) >= ms)


def exclude_internal(raw: DataFrame, column: str = "query") -> DataFrame:
    """Drops statements about the statistics view and the catalog."""
    text = F.col(column)
    return raw.where(~text.ilike("%pg\\_stat\\_statements%") & ~text.ilike("%pg\\_catalog%"))


def has_text(sql: Column) -> Column:
    return F.coalesce(sql.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def drop_blank_sql(raw: DataFrame, column: str = "sql_text") -> DataFrame:
    """Drops null, empty and all-blank statements."""
    return raw.where(has_text(F.col(column)))


def filter_queries(
    q: DataFrame, db_type: str | None = None, host: str | None = None, status: str | None = None
) -> DataFrame:
    """Optional equality filters; a filter that is not given is not in the plan."""
    for column, value in (
        ("source_db_type", db_type), ("source_db_host", host), ("status", status),
    ):
        if value:
            q = q.where(F.col(column) == value)
    return q


def search_sql(q: DataFrame, text: str) -> DataFrame:
    return q.where(F.col("full_sql").contains(text))


def query_detail(q: DataFrame, a: DataFrame, query_id: str) -> DataFrame:
    """One query with its analysis as a nested struct, null when there is none."""
    nested = a.where(F.col("slow_query_id") == query_id).select(
        F.col("slow_query_id").alias("id"), F.struct(*a.columns).alias("analysis")
    )
    return q.where(F.col("id") == query_id).join(nested, "id", "left")


def by_fingerprint(q: DataFrame, fingerprint: str, limit: int = 10) -> DataFrame:
    """Newest executions of one pattern, matched on the pattern text."""
    return (
        q.where(F.col("fingerprint") == fingerprint)
        .orderBy(F.col("captured_at").desc(), "id")
        .limit(limit)
    )


def delete_queries(q: DataFrame, a: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries and analyses that remain after deleting the queries in ``ids``."""
    gone = ids.select("id").distinct()
    return (
        q.join(gone, "id", "left_anti"),
        a.join(gone.select(F.col("id").alias("slow_query_id")), "slow_query_id", "left_anti"),
    )


def list_cases(
    backlog: DataFrame,
    db_type: str | None = None,
    effectiveness: str | None = None,
    min_gain: float | None = None,
) -> DataFrame:
    if db_type:
        backlog = backlog.where(F.col("db_type") == db_type)
    if effectiveness:
        backlog = backlog.where(F.col("effectiveness") == effectiveness)
    if min_gain is not None:
        backlog = backlog.where(F.col("gain_ratio") >= min_gain)
    return backlog


def pending_batch(q: DataFrame, limit: int | None = None) -> DataFrame:
    """NEW queries, oldest first when ``limit`` cuts the batch."""
    pending = q.where(F.col("status") == "NEW")
    return pending if limit is None else pending.orderBy("captured_at", "id").limit(limit)
