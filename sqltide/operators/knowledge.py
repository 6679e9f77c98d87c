"""Knowledge base of confirmed cases: build, report, rank, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.functions import text
from sqltide.operators.dedup import first_per_key
from sqltide.operators.ordered import dense_ranked

CASE_KEY = ("fingerprint", "db_type")
CASE_COLUMNS = (
    "id", "fingerprint", "db_type", "full_sql", "plan_json", "schema_context", "problem",
    "suggestions", "applied_fix", "old_duration_ms", "new_duration_ms", "gain_ratio",
    "effectiveness", "analyzer_version", "created_at", "updated_at",
)


def best_suggestion(suggestions: Column) -> Column:
    """The first suggestion of the highest priority present."""

    def first_of(priority: str) -> Column:
        return F.get(F.filter(suggestions, lambda s: s["priority"] == priority), F.lit(0))

    return F.coalesce(
        first_of("HIGH"), first_of("MEDIUM"), first_of("LOW"), F.get(suggestions, F.lit(0))
    )


def build_backlog(
    q: DataFrame,
    a: DataFrame,
    feedback: DataFrame,
    backlog: DataFrame | None = None,
    context: DataFrame | None = None,
) -> DataFrame:
    """Backlog with the confirmed analyses put in, one case per pattern and type.

    The latest measurement of a case wins.  Cases without a new one stay as
    they are; an updated case keeps its creation time.  Statement and plan are
    stored without names and literals.
    """
    queries = q.select(
        F.col("id").alias("slow_query_id"), "fingerprint", F.col("source_db_type").alias("db_type")
    )
    confirmed = a.where(F.col("effectiveness") == "CONFIRMED").select(
        F.col("id").alias("analysis_result_id"), "slow_query_id"
    )
    measured = feedback.select(
        "analysis_result_id", "old_duration_ms", "new_duration_ms", "gain_ratio", "checked_at"
    )
    joined = confirmed.join(measured, "analysis_result_id").join(queries, "slow_query_id")
    latest = first_per_key(
        joined, CASE_KEY, [F.col("checked_at").desc(), F.col("analysis_result_id")]
    )
    # The wide columns meet the winners alone.
    said = a.select(
        F.col("id").alias("analysis_result_id"), "problem", "suggestions", "analyzer_version"
    )
    texts = q.select(F.col("id").alias("slow_query_id"), "full_sql", "plan_json")
    latest = latest.join(said, "analysis_result_id").join(texts, "slow_query_id")
    if context is None:
        latest = latest.withColumn("schema_context", F.lit(None).cast("string"))
    else:
        notes = context.select(
            F.col("id").alias("slow_query_id"), F.to_json("schema_context").alias("schema_context")
        )
        latest = latest.join(notes, "slow_query_id", "left")
    sql = text.decode_hex_sql(F.col("full_sql"))
    fresh = latest.select(
        F.md5(F.concat_ws("|", *CASE_KEY).cast("binary")).alias("id"),
        *CASE_KEY,
        text.anonymize_sql(sql).alias("full_sql"),
        text.anonymize_plan(F.col("plan_json"), sql).alias("plan_json"),
        text.anonymize_plan(F.col("schema_context"), sql).alias("schema_context"),
        "problem",
        "suggestions",
        F.lit(None).cast("string").alias("applied_fix"),
        "old_duration_ms",
        "new_duration_ms",
        "gain_ratio",
        F.lit("CONFIRMED").alias("effectiveness"),
        "analyzer_version",
        F.col("checked_at").alias("created_at"),
        F.col("checked_at").alias("updated_at"),
    )
    return fresh if backlog is None else with_fresh_cases(fresh, backlog)


def with_fresh_cases(fresh: DataFrame, backlog: DataFrame) -> DataFrame:
    """The backlog with newly measured cases in place of their older ones, which lend their creation time."""
    born = backlog.select(*CASE_KEY, F.col("created_at").alias("_born"))
    updated = (
        fresh.join(born, list(CASE_KEY), "left")
        .withColumn("created_at", F.coalesce("_born", "created_at"))
        .select(*CASE_COLUMNS)
    )
    untouched = backlog.join(fresh.select(*CASE_KEY), list(CASE_KEY), "left_anti")
    return updated.unionByName(untouched.select(*CASE_COLUMNS))


def backlog_stats(backlog: DataFrame) -> DataFrame:
    """Cases, share confirmed, mean gain and the most frequent problem (first by name on a tie)."""
    confirmed = F.col("effectiveness") == "CONFIRMED"
    per_problem = backlog.groupBy("problem").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(confirmed).alias("confirmed"),
        F.sum("gain_ratio").alias("gain"),
        F.count("gain_ratio").alias("gains"),
    )
    named = F.when(F.col("problem").isNotNull(), F.struct(-F.col("cases"), F.col("problem")))
    return per_problem.agg(
        F.sum("cases").alias("cases"),
        F.try_divide(F.sum("confirmed").cast("double"), F.sum("cases")).alias("success_rate"),
        F.try_divide(F.sum("gain"), F.sum("gains")).alias("mean_gain"),
        F.min(named)["problem"].alias("top_problem"),
    )


def rule_ranking(a: DataFrame) -> DataFrame:
    """Suggestion types by mean gain, with the share of confirmed analyses."""
    kinds = a.select(
        "gain_ratio", "effectiveness", F.explode("suggestions.type").alias("suggestion_type")
    )
    per_kind = kinds.groupBy("suggestion_type").agg(
        F.count(F.lit(1)).alias("uses"),
        F.avg("gain_ratio").alias("mean_gain"),
        F.avg((F.col("effectiveness") == "CONFIRMED").cast("double")).alias("confirmed_share"),
    )
    return dense_ranked(per_kind, F.col("mean_gain").desc_nulls_last(), "mean_gain", "rank")


def training_rows(backlog: DataFrame, min_gain: float = 0.3) -> DataFrame:
    """Confirmed cases with enough gain as (input, output), names and literals removed."""
    kept = backlog.where(
        (F.col("effectiveness") == "CONFIRMED") & (F.col("gain_ratio") >= min_gain)
    )
    pattern = F.col("fingerprint")
    best = best_suggestion(F.col("suggestions"))
    return kept.select(
        F.struct(
            "db_type",
            text.anonymize_sql(pattern).alias("fingerprint"),
            text.anonymize_plan(F.col("plan_json"), pattern).alias("plan_json"),
            text.anonymize_plan(F.col("schema_context"), pattern).alias("schema_context"),
        ).alias("input"),
        F.struct(
            F.coalesce("applied_fix", best["sql"], best["description"]).alias("suggestion"),
            "gain_ratio",
        ).alias("output"),
    )


def export_training_dataset(backlog: DataFrame, path: str, min_gain: float = 0.3) -> None:
    """Training rows as JSON lines, one part file per task."""
    training_rows(backlog, min_gain).select(
        F.to_json(F.struct("input", "output")).alias("value")
    ).write.mode("overwrite").text(path)


def read_training_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The exported rows: ``input`` and ``output`` as they were written."""
    return spark.read.schema(
        "input struct<db_type:string,fingerprint:string,plan_json:string,schema_context:string>, "
        "output struct<suggestion:string,gain_ratio:double>"
    ).json(path)
