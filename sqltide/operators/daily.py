"""Pattern and day statistics kept per day, so that what arrives touches its own days only.

Each batch adds one row per pattern, source and day, with exact counts, sums and
extremes and a mergeable quantile sketch of the durations.  Summaries over any
span of days merge these rows; they never read the queries again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.operators.joins import PATTERN

# Size of a sketch: its quantiles are off by less than 0.9 % of the ranks 99 times of 100, and by no more
# than the stated error but once in many thousands.
SKETCH_K = 400
RANK_ERROR = 0.017
_DAY = "captured_date"
DAY_ROWS = (
    "fingerprint string, source_db_type string, source_db_host string, query_count bigint, known bigint, "
    "total_ms decimal(28,3), min_ms decimal(18,3), max_ms decimal(18,3), "
    "newest struct<captured_at:timestamp_ntz,id:string>, durations binary, captured_date date, batch_id bigint"
)


def day_rows(q: DataFrame) -> DataFrame:
    """One row per pattern, source and day.  Unknown durations count as queries only."""
    ms = F.col("duration_ms").cast("decimal(18,3)")
    return q.groupBy(*PATTERN, F.to_date("captured_at").alias(_DAY)).agg(
        F.count(F.lit(1)).alias("query_count"),
        F.count("duration_ms").alias("known"),
        F.sum(ms).cast("decimal(28,3)").alias("total_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        F.max(F.struct("captured_at", "id")).alias("newest"),
        F.kll_sketch_agg_double(F.col("duration_ms").cast("double"), F.lit(SKETCH_K)).alias("durations"),
    )


def add_days(q: DataFrame, batch_id: int, path: str) -> None:
    """Stores the rows of one batch under its days; a batch that runs again replaces its own."""
    (
        day_rows(q)
        .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(_DAY, "batch_id")
        .parquet(path)
    )


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAY_ROWS).parquet(path)


def _mean() -> Column:
    return F.try_divide(F.sum("total_ms").cast("double"), F.sum("known").cast("double"))


def summary_of_days(days: DataFrame) -> DataFrame:
    """Per pattern and source what ``pattern_summary`` tells of the queries alone.

    All is exact but the 95th percentile, which is that of the merged sketch: a
    duration whose rank is within ``RANK_ERROR`` of 0.95.
    """
    merged = days.groupBy(*PATTERN).agg(
        F.max("newest").alias("newest"),
        F.sum("query_count").alias("execution_count"),
        F.sum("known").alias("known"),
        _mean().alias("avg_duration_ms"),
        F.min("min_ms").cast("double").alias("min_duration_ms"),
        F.max("max_ms").cast("double").alias("max_duration_ms"),
        F.sum("total_ms").cast("double").alias("total_duration_ms"),
        F.kll_merge_agg_double("durations", F.lit(SKETCH_K)).alias("durations"),
    )
    p95 = F.when(F.col("known") > 0, F.kll_sketch_get_quantile_double("durations", F.lit(0.95)))
    return merged.select(
        *PATTERN,
        F.col("newest.id").alias("id"),
        "execution_count",
        "avg_duration_ms",
        "min_duration_ms",
        "max_duration_ms",
        p95.alias("p95_duration_ms"),
        "total_duration_ms",
        F.col("newest.captured_at").alias("last_seen"),
    )


def trend_of_days(days: DataFrame) -> DataFrame:
    """Per day the count, mean and maximum duration, as ``daily_trend`` gives them."""
    return days.groupBy(F.col(_DAY).alias("date")).agg(
        F.sum("query_count").alias("query_count"),
        _mean().alias("avg_duration_ms"),
        F.max("max_ms").cast("double").alias("max_duration_ms"),
    )
