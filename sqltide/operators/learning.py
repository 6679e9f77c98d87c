"""Learning loop: did a suggestion make its pattern faster?"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltide.functions import measures
from sqltide.operators.joins import PATTERN, lookup_join

# The limits between failed, pending and confirmed, and how many
# of the newest executions count.
IMPROVEMENT_THRESHOLD = 0.3
NEWEST = 5


def newest_executions(q: DataFrame, last_n: int = NEWEST) -> DataFrame:
    """Per pattern text its newest ``last_n`` executions of known duration as an array, newest first.

    The row limit is applied in every map task before the shuffle.
    """
    window = Window.partitionBy("fingerprint").orderBy(F.col("captured_at").desc(), F.col("id").desc())
    newest = (
        q.where(F.col("duration_ms").isNotNull())
        .select("fingerprint", "captured_at", "id", "duration_ms")
        .withColumn("_nth", F.row_number().over(window))
        .where(F.col("_nth") <= last_n)
    )
    entry = F.struct("captured_at", F.col("id").alias("execution_id"), "duration_ms")
    return newest.groupBy("fingerprint").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("newest")
    )


def before_after(
    a: DataFrame, q: DataFrame, tolerance: str = "10 minutes", last_n: int = NEWEST
) -> DataFrame:
    """Per analysis its own execution and the newest later ones of the pattern.

    Later means strictly after the old time plus the tolerance.  The newest
    ``last_n`` of those are always among the newest ``last_n`` of the pattern,
    so no analysis meets all executions of its pattern.  Tables with one row
    per pattern, such as statement statistics, never have later rows.
    """
    old = q.select(
        F.col("id").alias("slow_query_id"),
        "fingerprint",
        F.col("duration_ms").cast("double").alias("old_duration_ms"),
        F.col("captured_at").alias("old_time"),
    )
    analysed = a.select(F.col("id").alias("analysis_id"), "slow_query_id").join(old, "slow_query_id")
    joined = lookup_join(analysed, newest_executions(q, last_n), ["fingerprint"])
    start = F.col("old_time") + F.expr(f"interval {tolerance}")
    return joined.withColumn(
        "after", F.filter("newest", lambda e: e["captured_at"] > start)
    ).drop("newest")


def evaluate_effectiveness(
    a: DataFrame,
    q: DataFrame,
    tolerance: str = "10 minutes",
    last_n: int = NEWEST,
    min_obs: int = 1,
) -> DataFrame:
    """All analyses with gain and effectiveness brought up to date.

    Only PENDING ones are measured.  Adds fingerprint, old and new duration
    of those that had at least ``min_obs`` later executions, of the ``last_n``
    that are looked at.
    """
    if min_obs > last_n:
        raise ValueError("min_obs is at most last_n")
    pending = a.where(F.col("effectiveness") == "PENDING")
    total = F.aggregate(
        "after", F.lit(0.0), lambda acc, e: acc + e["duration_ms"].cast("double")
    )
    gain = measures.gain_ratio(F.col("old_duration_ms"), F.col("new_duration_ms"))
    measured = (
        before_after(pending, q, tolerance, last_n)
        .where(F.size("after") >= max(min_obs, 1))
        .withColumn("new_duration_ms", F.try_divide(total, F.size("after").cast("double")))
        .select(
            F.col("analysis_id").alias("id"),
            "fingerprint",
            "old_duration_ms",
            "new_duration_ms",
            gain.alias("_gain"),
        )
    )
    new_state = (
        F.when(F.col("_gain") < 0, F.lit("FAILED"))
        .when(F.col("_gain") < IMPROVEMENT_THRESHOLD, F.lit("PENDING"))
        .when(F.col("_gain") >= IMPROVEMENT_THRESHOLD, F.lit("CONFIRMED"))
        .otherwise(F.col("effectiveness"))
    )
    return (
        a.join(measured, "id", "left")
        .withColumn("effectiveness", new_state)
        .withColumn("gain_ratio", F.coalesce("_gain", "gain_ratio"))
        .drop("_gain")
    )


def append_feedback(
    evaluated: DataFrame,
    history: DataFrame,
    as_of: str | datetime,
    recent: str = "30 minutes",
) -> DataFrame:
    """New feedback rows; none for an analysis that has a recent one."""
    now = measures.at(as_of)
    recent_rows = history.where(F.col("checked_at") > now - F.expr(f"interval {recent}"))
    known = recent_rows.select(F.col("analysis_result_id").alias("id")).distinct()
    checked = evaluated.where(F.col("new_duration_ms").isNotNull()).join(known, "id", "left_anti")
    return checked.select(
        F.md5(F.concat_ws("|", "id", now.cast("string")).cast("binary")).alias("id"),
        F.col("fingerprint").alias("slow_query_fingerprint"),
        F.col("id").alias("analysis_result_id"),
        "old_duration_ms",
        "new_duration_ms",
        "gain_ratio",
        now.alias("checked_at"),
    )


def pattern_list(summary: DataFrame, effectiveness: DataFrame) -> DataFrame:
    """The pattern summary with the best state and gain that suggestions to a pattern reached."""
    return summary.join(effectiveness, "fingerprint", "left")


def pattern_effectiveness(a: DataFrame, q: DataFrame) -> DataFrame:
    """Best state any suggestion of a pattern reached, and its best confirmed gain."""
    text = q.select(F.col("id").alias("slow_query_id"), F.col("fingerprint"))
    rank = measures.effectiveness_rank(F.col("effectiveness"))
    return (
        a.select("slow_query_id", "effectiveness", "gain_ratio")
        .join(text, "slow_query_id")
        .groupBy("fingerprint")
        .agg(
            F.max(rank).alias("_rank"),
            F.max(F.when(F.col("effectiveness") == "CONFIRMED", F.col("gain_ratio"))).alias(
                "last_suggestion_gain"
            ),
        )
        .select(
            "fingerprint",
            measures.effectiveness_of_rank(F.nullif("_rank", F.lit(0))).alias(
                "effectiveness_best"
            ),
            "last_suggestion_gain",
        )
    )


def detect_regressions(q: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    """Patterns whose mean of the newest ``days`` is worse than their mean before."""
    start = measures.days_before(as_of, days)
    recent = F.col("captured_at") >= start
    ms = F.col("duration_ms")

    def mean(condition: Column) -> Column:
        return F.try_divide(
            F.sum(F.when(condition, ms)).cast("double"),
            F.count(F.when(condition, ms)).cast("double"),
        )

    means = (
        q.where(F.col("captured_at") < measures.at(as_of))
        .groupBy(*PATTERN)
        .agg(mean(~recent).alias("before_ms"), mean(recent).alias("recent_ms"))
    )
    gain = measures.gain_ratio(F.col("before_ms"), F.col("recent_ms"))
    return means.withColumn("gain_ratio", gain).where(F.col("gain_ratio") < 0)
