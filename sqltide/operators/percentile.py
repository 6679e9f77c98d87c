"""Exact continuous percentile per group, safe for very large groups.

Spark's ``percentile`` holds every distinct value of a group in one task.
Here the rank is found in two counting passes instead: first over buckets one
second wide, then over the distinct values inside the bucket that holds the
rank.  Durations up to 34 days, the longest that a slow log can hold, make at
most 3 * 10**6 such buckets and 10**6 values in each, which bounds the work per
task whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_UNIT = 1_000
STEPS_PER_BUCKET = 1_000_000


def steps(value: Column) -> Column:
    """A decimal with three digits as a whole number of thousandths."""
    return (value * STEPS_PER_UNIT).cast("bigint")


def bucket_of(value: Column) -> Column:
    return F.floor(steps(value) / STEPS_PER_BUCKET)


def rank_buckets(
    buckets: DataFrame, keys: Sequence[str], fraction: float, bucket: str, count: str
) -> DataFrame:
    """Keeps the one or two buckets of each group that hold the wanted ranks.

    Adds ``_before`` (rows in lower buckets), ``_lo``, ``_hi`` (ranks from 0)
    and ``_part`` (the way from the lower to the higher value).
    """
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (F.sum(count).over(group) - 1) * F.lit(float(fraction))
    end = F.col("_end")
    return (
        buckets.withColumns(
            {"_end": F.sum(count).over(ordered), "_place": place}
        )
        .withColumns(
            {
                "_before": end - F.col(count),
                "_lo": F.floor("_place"),
                "_hi": F.ceil("_place"),
                "_part": F.col("_place") - F.floor("_place"),
            }
        )
        .where(
            ((F.col("_before") <= F.col("_lo")) & (F.col("_lo") < end))
            | ((F.col("_before") <= F.col("_hi")) & (F.col("_hi") < end))
        )
        .drop("_end", "_place")
    )


def values_at_ranks(
    counts: DataFrame, ranked: DataFrame, keys: Sequence[str], bucket: str
) -> DataFrame:
    """``ranked`` with ``_lo_value`` and ``_hi_value`` (null where in the other bucket).

    ``counts`` has one row per group and distinct value: ``_steps``, ``_n`` and the bucket.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy("_steps")
    joined = (
        counts.join(ranked, [*keys, bucket])
        .withColumn(
            "_end",
            F.col("_before")
            + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )

    def at_rank(rank: str) -> Column:
        hit = (F.col("_start") <= F.col(rank)) & (F.col(rank) < F.col("_end"))
        return F.when(hit, F.col("_steps") / STEPS_PER_UNIT)

    return joined.withColumns({"_lo_value": at_rank("_lo"), "_hi_value": at_rank("_hi")}).where(
        F.col("_lo_value").isNotNull() | F.col("_hi_value").isNotNull()
    )


def between_ranks() -> Column:
    """Aggregate over the rows of ``values_at_ranks``: the interpolated value."""
    low, high = F.max("_lo_value"), F.max("_hi_value")
    return low + (high - low) * F.max("_part")


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, fraction: float, name: str
) -> DataFrame:
    """One row per group with the exact continuous percentile of a decimal column."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, steps(F.col(value)).alias("_steps"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.floor(F.col("_steps") / STEPS_PER_BUCKET))
    )
    buckets = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_rows"))
    ranked = rank_buckets(buckets, keys, fraction, "_bucket", "_rows")
    found = values_at_ranks(counts, ranked, keys, "_bucket")
    return found.groupBy(*keys).agg(between_ranks().alias(name))
