"""Pages, top lists and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.functions import text
from sqltide.operators.joins import PATTERN
from sqltide.operators.ordered import numbered, with_previous


def _slowest() -> list[Column]:
    return [F.col("avg_duration_ms").desc(), *[F.col(c).asc() for c in PATTERN]]


def _slowest_first(summary: DataFrame) -> DataFrame:
    return summary.orderBy(*_slowest())


def page_patterns(summary: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page, slowest patterns first; rows before it are counted by piece, not gathered."""
    if page < 1 or not 1 <= page_size <= 200:
        raise ValueError("page starts at 1 and page_size is 1 to 200")
    first = (page - 1) * page_size + 1
    found = numbered(summary, _slowest(), "_place", first, first + page_size - 1)
    return found.orderBy("_place").drop("_place")


def page_totals(summary: DataFrame, page_size: int = 50) -> DataFrame:
    total = F.count(F.lit(1))
    return summary.agg(
        total.alias("total"), F.ceil(total / F.lit(page_size)).cast("bigint").alias("total_pages")
    )


def top_tables(tables: DataFrame, limit: int = 10, db_type: str | None = None) -> DataFrame:
    if db_type:
        tables = tables.where(F.col("source_db_type") == db_type)
    return tables.orderBy(
        F.col("query_count").desc(), "source_db_type", "source_db_host", "table_name"
    ).limit(limit)


def top_slow_patterns(
    summary: DataFrame, limit: int = 10, min_duration_ms: float | None = None
) -> DataFrame:
    if min_duration_ms is not None:
        summary = summary.where(F.col("avg_duration_ms") >= min_duration_ms)
    return _slowest_first(summary).limit(limit)


def unanalyzed_patterns(summary: DataFrame, limit: int = 10) -> DataFrame:
    return _slowest_first(summary.where(~F.col("has_analysis"))).limit(limit)


def slowest_cases(q: DataFrame, limit: int = 5) -> DataFrame:
    """Slowest execution per marked case, slowest cases first."""
    return (
        q.select(text.test_marker(F.col("full_sql"))["case_id"].alias("case_id"), "duration_ms")
        .where(F.col("case_id").isNotNull())
        .groupBy("case_id")
        .agg(F.max("duration_ms").cast("double").alias("max_duration_ms"))
        .orderBy(F.col("max_duration_ms").desc(), "case_id")
        .limit(limit)
    )


def pattern_timeline(q: DataFrame, feedback: DataFrame, fingerprint: str | None = None) -> DataFrame:
    """Executions and feedback of a pattern, sorted by pattern, time, kind and id.

    Each execution has its change to the previous one of the same pattern
    and source; a feedback row has its gain.
    """
    if fingerprint is not None:
        q = q.where(F.col("fingerprint") == fingerprint)
        feedback = feedback.where(F.col("slow_query_fingerprint") == fingerprint)
    runs = with_previous(
        q.select(*PATTERN, "captured_at", "id", "duration_ms"),
        PATTERN, ["captured_at", "id"], "duration_ms", "previous_ms",
    )
    executions = runs.select(
        "fingerprint",
        "source_db_type",
        "source_db_host",
        F.col("captured_at").alias("at"),
        F.lit("EXECUTION").alias("kind"),
        "id",
        F.col("duration_ms").cast("double").alias("duration_ms"),
        (F.col("duration_ms") - F.col("previous_ms")).cast("double").alias("change_ms"),
        F.lit(None).cast("double").alias("gain_ratio"),
    )
    checks = feedback.select(
        F.col("slow_query_fingerprint").alias("fingerprint"),
        F.lit(None).cast("string").alias("source_db_type"),
        F.lit(None).cast("string").alias("source_db_host"),
        F.col("checked_at").alias("at"),
        F.lit("FEEDBACK").alias("kind"),
        "id",
        F.col("new_duration_ms").alias("duration_ms"),
        (F.col("new_duration_ms") - F.col("old_duration_ms")).alias("change_ms"),
        "gain_ratio",
    )
    return executions.unionByName(checks).orderBy("fingerprint", "at", "kind", "id")
