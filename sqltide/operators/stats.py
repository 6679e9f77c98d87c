"""Workload statistics: per pattern, table, database, day, level and case."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltide.functions import measures, text
from sqltide.functions.plan_json import has_plan, plan_features
from sqltide.operators import percentile
from sqltide.operators.filters import filter_queries
from sqltide.operators.joins import PATTERN, representative_query

SOURCE = ("source_db_type", "source_db_host")


def _pattern_key() -> Column:
    """A key of pattern and source that is never null, so that groups of nulls join as well."""
    parts = [F.coalesce(c, F.lit("\x00")) for c in PATTERN]
    return F.md5(F.concat_ws("\x1f", *parts).cast("binary"))


def _mean(total: Column, count: Column) -> Column:
    """Exact decimal total over count, so the result does not depend on row order."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def pattern_summary(
    q: DataFrame,
    a: DataFrame,
    db_type: str | None = None,
    host: str | None = None,
    status: str | None = None,
    min_duration_ms: float | None = None,
) -> DataFrame:
    """Executions per pattern and source, with the exact 95th percentile.

    ``id`` is the newest execution of the pattern, whatever its status.  The
    highest improvement level is by severity.  Unknown durations count as
    executions but not in the mean and percentile; a pattern or source that is
    null is a group as well.
    """
    scoped = filter_queries(q, db_type, host, status)
    levels = a.select(
        F.col("slow_query_id").alias("id"),
        measures.improvement_rank(F.col("improvement_level")).alias("level_rank"),
    )
    rows = scoped.select(
        _pattern_key().alias("_key"), "id", *PATTERN, "duration_ms", "captured_at", "status"
    ).join(levels, "id", "left")
    # One pass over the rows: everything below starts from the distinct durations.
    values = rows.groupBy("_key", *PATTERN, "duration_ms").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct("captured_at", "id")).alias("_newest"),
        F.bool_or(F.col("status") == "ANALYZED").alias("_analyzed"),
        F.max("level_rank").alias("_rank"),
    )
    values = values.withColumns(
        {"_steps": percentile.steps(F.col("duration_ms")), "_bucket": percentile.bucket_of(F.col("duration_ms"))}
    )
    total = F.sum(F.col("duration_ms") * F.col("_n"))
    buckets = values.groupBy("_key", *PATTERN, "_bucket").agg(
        F.sum("_n").alias("_rows"),
        total.alias("_sum"),
        F.min("duration_ms").alias("_min"),
        F.max("duration_ms").alias("_max"),
        F.max("_newest").alias("_newest"),
        F.bool_or("_analyzed").alias("_analyzed"),
        F.max("_rank").alias("_rank"),
    )
    known = F.col("_bucket").isNotNull()
    totals = buckets.groupBy("_key").agg(
        *[F.max(c).alias(c) for c in PATTERN],
        F.sum("_rows").alias("execution_count"),
        F.coalesce(F.sum(F.when(known, F.col("_rows"))), F.lit(0)).alias("_timed"),
        F.sum("_sum").alias("total_duration_ms"),
        F.min("_min").alias("min_duration_ms"),
        F.max("_max").alias("max_duration_ms"),
        F.max("_newest").alias("_newest"),
        F.bool_or("_analyzed").alias("has_analysis"),
        F.max("_rank").alias("_rank"),
    )
    mean = _mean(F.col("total_duration_ms"), F.col("_timed"))
    if min_duration_ms is not None:
        totals = totals.where(mean >= min_duration_ms)
    ranked = percentile.rank_buckets(
        buckets.where(known).select("_key", "_bucket", "_rows"), ["_key"], 0.95, "_bucket", "_rows"
    )
    found = percentile.values_at_ranks(
        values.where(known).select("_key", "_bucket", "_steps", "_n"), ranked, ["_key"], "_bucket"
    )
    high = found.groupBy("_key").agg(percentile.between_ranks().alias("p95_duration_ms"))
    summary = totals.join(high, "_key", "left")
    summary = summary.select(
        *PATTERN,
        F.col("_newest.id").alias("id"),
        "execution_count",
        mean.alias("avg_duration_ms"),
        F.col("min_duration_ms").cast("double").alias("min_duration_ms"),
        F.col("max_duration_ms").cast("double").alias("max_duration_ms"),
        "p95_duration_ms",
        F.col("total_duration_ms").cast("double").alias("total_duration_ms"),
        F.col("_newest.captured_at").alias("last_seen"),
        "has_analysis",
        measures.level_of_rank(F.nullif("_rank", F.lit(0))).alias("max_improvement_level"),
    )
    if status:
        newest = representative_query(filter_queries(q, db_type, host))
        summary = summary.drop("id").join(newest, list(PATTERN))
    return summary


def database_stats(q: DataFrame, a: DataFrame) -> DataFrame:
    """Counts, mean duration and high-impact analyses per source, in one pass."""
    high = a.where(F.col("improvement_level").isin("HIGH", "CRITICAL")).select(
        F.col("slow_query_id").alias("id"), F.lit(1).alias("high")
    )
    return (
        q.select("id", *SOURCE, "status", "duration_ms")
        .join(high, "id", "left")
        .groupBy(*SOURCE)
        .agg(
            F.count(F.lit(1)).alias("total_slow_queries"),
            F.count_if(F.col("status") == "ANALYZED").alias("analyzed_queries"),
            F.count_if(F.col("status") == "NEW").alias("pending_queries"),
            F.coalesce(
                _mean(F.sum("duration_ms"), F.count("duration_ms")), F.lit(0.0)
            ).alias("avg_duration_ms"),
            F.count("high").alias("high_impact_count"),
        )
    )


def global_totals(q: DataFrame) -> DataFrame:
    return q.agg(
        F.count(F.lit(1)).alias("total_slow_queries"),
        F.count_if(F.col("status") == "ANALYZED").alias("total_analyzed"),
        F.count_if(F.col("status") == "NEW").alias("total_pending"),
        F.count_distinct("source_db_host").alias("databases_monitored"),
    )


def improvement_summary(a: DataFrame) -> DataFrame:
    level = F.coalesce(F.nullif(F.col("improvement_level"), F.lit("")), F.lit("UNKNOWN"))
    return a.groupBy(level.alias("improvement_level")).agg(F.count(F.lit(1)).alias("count"))


def daily_trend(q: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    """Per day from ``days`` before ``as_of``: count, mean and maximum duration."""
    return (
        q.where(F.col("captured_at") >= measures.days_before(as_of, days))
        .groupBy(F.to_date("captured_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            _mean(F.sum("duration_ms"), F.count("duration_ms")).alias("avg_duration_ms"),
            F.max("duration_ms").cast("double").alias("max_duration_ms"),
        )
        .orderBy("date")
    )


def monitored_databases(q: DataFrame) -> DataFrame:
    return q.groupBy(*SOURCE, "source_db_name").agg(
        F.count(F.lit(1)).alias("slow_queries_count"), F.max("captured_at").alias("last_seen")
    )


def analyzer_status(q: DataFrame, a: DataFrame) -> DataFrame:
    """Query counts by status and analysis counts by level, in one aggregate.

    IGNORED queries are in no total; CRITICAL analyses only in theirs.
    """
    both = q.select("status", F.lit(None).cast("string").alias("level"), F.lit(0).alias("done"))
    both = both.unionByName(
        a.select(
            F.lit(None).cast("string").alias("status"),
            F.col("improvement_level").alias("level"),
            F.lit(1).alias("done"),
        )
    )
    status, level = F.col("status"), F.col("level")
    return both.agg(
        F.count_if(status == "NEW").alias("pending"),
        F.count_if(status == "ANALYZED").alias("analyzed"),
        F.count_if(status == "ERROR").alias("error"),
        F.count_if(status.isin("NEW", "ANALYZED", "ERROR")).alias("total"),
        F.count_if(F.col("done") == 1).alias("analyses_total"),
        F.count_if(level == "HIGH").alias("high_impact"),
        F.count_if(level == "MEDIUM").alias("medium_impact"),
        F.count_if(level == "LOW").alias("low_impact"),
    )


def impactful_tables(
    q: DataFrame, db_type: str | None = None, from_plan: bool = False
) -> DataFrame:
    """Queries, mean duration and distinct patterns per source and table.

    Tables come from the statement text, or from the plan's root table.
    """
    q = filter_queries(q, db_type)
    if from_plan:
        plan = plan_features(F.col("plan_json"), F.col("source_db_type"))
        tables = q.where(has_plan(F.col("plan_json"))).withColumn(
            "table_name", F.coalesce(plan["table_name"], plan["relation_name"])
        ).where(F.col("table_name").isNotNull())
    else:
        tables = q.withColumn(
            "table_name",
            F.explode(text.extract_tables(text.decode_hex_sql(F.col("full_sql")))),
        )
    return tables.groupBy(*SOURCE, "table_name").agg(
        F.count(F.lit(1)).alias("query_count"),
        _mean(F.sum("duration_ms"), F.count("duration_ms")).alias("avg_duration_ms"),
        F.count_distinct("sql_hash").alias("distinct_queries"),
    )


# Bands of the case report, in milliseconds.
VERY_SLOW_MS = 2_000
SLOW_MS = 500


def case_band_summary(q: DataFrame) -> DataFrame:
    """Marked cases by speed band, per category and in total (category ALL)."""
    marked = q.select(
        text.test_marker(F.col("full_sql"))["category"].alias("category"), "duration_ms"
    ).where(F.col("category").isNotNull())
    ms, total = F.col("duration_ms"), F.count(F.lit(1))
    bands = {
        "very_slow": F.count_if(ms > VERY_SLOW_MS),
        "slow": F.count_if((ms > SLOW_MS) & (ms <= VERY_SLOW_MS)),
        "ok": F.count_if(ms <= SLOW_MS),
    }
    return (
        marked.rollup("category")
        .agg(
            F.grouping("category").alias("_all"),
            total.alias("total"),
            *[n.alias(name) for name, n in bands.items()],
            *[(n * 100.0 / total).alias(f"{name}_percent") for name, n in bands.items()],
        )
        .withColumn(
            "category", F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("category"))
        )
        .drop("_all")
    )


def source_counts(q: DataFrame) -> DataFrame:
    return q.groupBy("source_db_type").agg(F.count(F.lit(1)).alias("count"))


def improvement_opportunities(summary: DataFrame) -> DataFrame:
    """Patterns whose best level is at least MEDIUM, worst and costliest first."""
    rank = measures.improvement_rank(F.col("max_improvement_level"))
    return summary.where(rank >= 2).orderBy(
        rank.desc(), F.col("total_duration_ms").desc(), *PATTERN
    )


# The levels that the summary of a whole workload names; any other text counts as OTHER.
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL", "UNKNOWN")


def global_stats(
    q: DataFrame, a: DataFrame, as_of: str | datetime, days: int = 7, top: int = 5
) -> DataFrame:
    """One nested row: totals, top tables, levels and trend.

    The queries are read once: each row counts in the totals, in its day and
    in its tables.  The parts are ranked before they are gathered, so the one
    row is made of ``top`` tables, ``days`` + 1 days and six levels at most.
    """
    nothing = F.lit(None).cast("string")

    def unit(part: str, one: Column, kind=nothing, host=nothing, table=nothing, date=F.lit(None)) -> Column:
        # ``one`` is what distinct counts of the part are over.
        return F.struct(
            F.lit(part).alias("part"), one.alias("one"), kind.alias("source_db_type"),
            host.alias("source_db_host"), table.alias("table_name"), date.cast("date").alias("date"),
        )

    recent = F.when(F.col("captured_at") >= measures.days_before(as_of, days), F.to_date("captured_at"))
    tables = F.transform(
        text.extract_tables(text.decode_hex_sql(F.col("full_sql"))),
        lambda t: unit("table", F.col("sql_hash"), F.col("source_db_type"), F.col("source_db_host"), t),
    )
    fixed = F.array(unit("total", F.col("source_db_host")), unit("day", nothing, date=recent))
    keys = ["part", "source_db_type", "source_db_host", "table_name", "date"]
    counted = (
        q.select("status", "duration_ms", F.explode(F.concat(fixed, F.coalesce(tables, F.slice(fixed, 1, 0)))).alias("u"))
        .select("status", "duration_ms", "u.*")
        .where("part <> 'day' OR date IS NOT NULL")
        .groupBy(*keys, "one")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") == "ANALYZED").alias("analyzed"),
            F.count_if(F.col("status") == "NEW").alias("pending"),
            F.sum("duration_ms").alias("ms"),
            F.count("duration_ms").alias("known"),
            F.max("duration_ms").alias("most"),
        )
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in ("n", "analyzed", "pending", "ms", "known")],
            F.max("most").cast("double").alias("most"),
            F.count("one").alias("distinct"),
        )
        .withColumn("mean", _mean(F.col("ms"), F.col("known")))
        .drop("ms", "known")
    )
    level = F.coalesce(F.nullif(F.col("improvement_level"), F.lit("")), F.lit("UNKNOWN"))
    level = F.when(level.isin(*LEVELS), level).otherwise(F.lit("OTHER"))
    levels = a.groupBy(level.alias("table_name")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("level"))
    parts = counted.unionByName(levels, allowMissingColumns=True)
    order = Window.partitionBy("part").orderBy(
        F.col("n").desc(), "source_db_type", "source_db_host", "table_name", "date"
    )
    kept = parts.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= F.lit(max(top, days + 1, len(LEVELS) + 1))
    ).where((F.col("part") != "table") | (F.col("place") <= top))
    of = lambda part: F.col("part") == part

    def packed(part: str, *fields: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(of(part), F.struct(*fields))))

    total = lambda c: F.coalesce(F.max(F.when(of("total"), F.col(c))), F.lit(0))
    return kept.agg(
        total("n").alias("total_slow_queries"),
        total("analyzed").alias("total_analyzed"),
        total("pending").alias("total_pending"),
        total("distinct").alias("databases_monitored"),
        packed(
            "table", (-F.col("n")).alias("order"), F.col("source_db_type"), F.col("source_db_host"),
            F.col("table_name"), F.col("n").alias("query_count"), F.col("mean").alias("avg_duration_ms"),
            F.col("distinct").alias("distinct_queries"),
        ).alias("top_tables"),
        packed("level", F.col("table_name").alias("improvement_level"), F.col("n").alias("count")).alias(
            "improvement_summary"
        ),
        packed(
            "day", F.col("date"), F.col("n").alias("query_count"), F.col("mean").alias("avg_duration_ms"),
            F.col("most").alias("max_duration_ms"),
        ).alias("recent_trend"),
    )
