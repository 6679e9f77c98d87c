"""From pending queries to analysis results and new statuses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.functions.measures import at
from sqltide.operators.filters import pending_batch
from sqltide.plans.replies import laid_over, merge_ai
from sqltide.plans.rules import Rule, dispatch_rules
from sqltide.schemas import ANALYSIS_METADATA


def rule_findings(
    q: DataFrame,
    strict: bool = False,
    extra: Mapping[str, Sequence[Rule]] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Findings of the rules per query, with the columns ``keep``; failed analyses give no row."""
    return (
        dispatch_rules(q, strict, extra)
        .where(~F.col("analysis_failed"))
        .select(
            F.col("id").alias("slow_query_id"),
            *keep,
            "problem",
            "root_cause",
            "suggestions",
            "improvement_level",
            "estimated_speedup",
            "confidence",
            F.lit("rule_based").alias("method"),
            F.struct(
                F.col("tables"),
                F.lit(None).cast("array<string>").alias("ai_insights"),
                F.lit(None).cast("string").alias("ai_provider"),
                F.lit(None).cast("string").alias("ai_model"),
            ).alias("metadata"),
        )
    )


def analysis_id(slow_query_id: Column, version: str) -> Column:
    """The same id on every run, so that a re-run task writes the same rows."""
    return F.md5(F.concat_ws("|", slow_query_id, F.lit(version)).cast("binary"))


def to_results(findings: DataFrame, as_of: Column | str | datetime, version: str = "1.0.0") -> DataFrame:
    """Findings in the shape of the analysis_result table."""
    return findings.select(
        analysis_id(F.col("slow_query_id"), version).alias("id"),
        "slow_query_id",
        "problem",
        "root_cause",
        "suggestions",
        "improvement_level",
        "estimated_speedup",
        F.lit(version).alias("analyzer_version"),
        F.col("method").alias("analysis_method"),
        F.col("confidence").alias("confidence_score"),
        F.col("metadata").cast(ANALYSIS_METADATA).alias("analysis_metadata"),
        at(as_of).alias("analyzed_at"),
        F.lit(None).cast("double").alias("gain_ratio"),
        F.lit("PENDING").alias("effectiveness"),
    )


def analyze(
    q: DataFrame,
    as_of: Column | str | datetime,
    version: str = "1.0.0",
    replies: DataFrame | None = None,
    strict: bool = False,
    extra: Mapping[str, Sequence[Rule]] | None = None,
) -> DataFrame:
    """Analysis results of every given query; a projection when there are no replies."""
    findings = rule_findings(q, strict, extra)
    if replies is not None:
        findings = merge_ai(findings, replies)
    return to_results(findings, as_of, version)


def analyze_answered(q: DataFrame, as_of: Column | str | datetime, version: str = "1.0.0") -> DataFrame:
    """Analysis results of queries that have their parsed reply in ``ai``; a projection."""
    return to_results(laid_over(rule_findings(q, keep=["ai"])), as_of, version)


def analyze_pending(
    q: DataFrame,
    a: DataFrame,
    as_of: str | datetime,
    limit: int | None = None,
    version: str = "1.0.0",
    replies: DataFrame | None = None,
) -> DataFrame:
    """Results for NEW queries that have none yet."""
    done = a.select(F.col("slow_query_id").alias("id"))
    pending = pending_batch(q, limit).join(done, "id", "left_anti")
    return analyze(pending, as_of, version, replies)


def apply_status(q: DataFrame, results: DataFrame, a: DataFrame | None = None) -> DataFrame:
    """NEW queries become ANALYZED with a result and ERROR without.

    A NEW query that already has an analysis in ``a`` was skipped and keeps
    its status.
    """
    marks = results.select(F.col("slow_query_id").alias("id"), F.lit("ANALYZED").alias("_mark"))
    if a is not None:
        kept = a.select(F.col("slow_query_id").alias("id"), F.lit("NEW").alias("_mark"))
        marks = marks.unionByName(kept)
    marked = q.join(marks, "id", "left")
    status = F.when(
        F.col("status") == "NEW", F.coalesce(F.col("_mark"), F.lit("ERROR"))
    ).otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("_mark")


def explode_suggestions(a: DataFrame) -> DataFrame:
    """One row per suggestion with its position, counted from 1."""
    return a.select(
        F.col("id").alias("analysis_id"),
        "slow_query_id",
        F.posexplode("suggestions").alias("pos", "item"),
    ).select(
        "analysis_id", "slow_query_id", (F.col("pos") + 1).alias("position"), "item.*"
    )
