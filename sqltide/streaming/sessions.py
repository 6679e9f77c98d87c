"""Sessions of sources of any size, kept as partial sessions and joined when read.

Rows are first made to sessions within a source and a piece of time, so a source
that holds most rows is worked on by as many tasks as it has pieces.  Partial
sessions of one piece, from whatever batches, are merged; then only those that
reach a border of their piece, two for each piece at most, are joined across it.
Nothing is held in streaming state and no row is too late.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sqltide.operators.stats import SOURCE
from sqltide.streaming.jobs import each_batch, replace_batch, to_instant, to_naive

_CAPTURED = "captured_at"
_NUMBERS = ("query_count", "known", "total_ms", "max_ms")


def partial_sessions(rows: DataFrame, gap: str, by: Sequence[str] = SOURCE, piece: str = "1 hour") -> DataFrame:
    """Sessions within each piece of time: ``start`` and ``last`` are the times of their first and last row."""
    instant = to_instant(F.col(_CAPTURED))
    # One window function per plan: the piece is the start of a fixed window, counted from the epoch.
    length = F.expr(f"cast(interval {piece} as interval day to second)")
    seconds = F.extract(F.lit("DAY"), length) * 86400 + F.extract(F.lit("HOUR"), length) * 3600 + F.extract(
        F.lit("MINUTE"), length
    ) * 60 + F.extract(F.lit("SECOND"), length)
    number = F.floor(F.unix_micros(instant) / (seconds * 1_000_000).cast("bigint"))
    timed = rows.where(F.col(_CAPTURED).isNotNull()).select(
        *by, "duration_ms", number.alias("piece"), (seconds * 1_000_000).cast("bigint").alias("piece_us"),
        instant.alias("at"),
    )
    sessions = timed.groupBy(F.session_window("at", gap).alias("session"), *by, "piece", "piece_us").agg(
        F.min("at").alias("start"),
        F.max("at").alias("last"),
        F.count(F.lit(1)).alias("query_count"),
        F.count("duration_ms").alias("known"),
        F.sum(F.col("duration_ms").cast("decimal(18,3)")).alias("total_ms"),
        F.max(F.col("duration_ms").cast("decimal(18,3)")).alias("max_ms"),
    )
    return sessions.select(
        *by, "piece", "piece_us", to_naive(F.col("start")).alias("start"), to_naive(F.col("last")).alias("last"), *_NUMBERS
    )


def _joined(parts: DataFrame, keys: Sequence[str], gap: Column) -> DataFrame:
    """Sessions of a key that lie within the gap of each other made one."""
    inside = Window.partitionBy(*keys).orderBy("start", "last")
    reach = F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("start") > reach + gap)).cast("int")
    counted = parts.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(inside))
    return counted.groupBy(*keys, "_session").agg(
        F.min("start").alias("start"),
        F.max("last").alias("last"),
        *[F.sum(c).alias(c) for c in ("query_count", "known", "total_ms")],
        F.max("max_ms").alias("max_ms"),
    ).drop("_session")


def merged_sessions(parts: DataFrame, gap: str, by: Sequence[str] = SOURCE) -> DataFrame:
    """Whole sessions of partial ones: the same as sessions of all rows at once.

    ``end`` is the last row's time plus the gap.  Unknown durations count as
    queries, not in the mean.
    """
    length = F.expr(f"interval {gap}")
    in_piece = _joined(parts, [*by, "piece", "piece_us"], length)
    border = F.timestamp_micros(F.col("piece") * F.col("piece_us"))
    first, after = to_naive(border), to_naive(F.timestamp_micros((F.col("piece") + 1) * F.col("piece_us")))
    reaches = (F.col("start") - length <= first) | (F.col("last") + length >= after)
    marked = in_piece.withColumn("_reaches", reaches)
    columns = [*by, "start", "last", *_NUMBERS]
    across = _joined(marked.where("_reaches").select(*columns), list(by), length)
    every = marked.where("NOT _reaches").select(*columns).unionByName(across.select(*columns))
    return every.select(
        *by,
        "start",
        (F.col("last") + length).alias("end"),
        "query_count",
        F.try_divide(F.col("total_ms").cast("double"), F.col("known").cast("double")).alias("avg_duration_ms"),
        F.col("max_ms").cast("double").alias("max_duration_ms"),
    )


def sessions_into_store(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    gap: str,
    by: Sequence[str] = SOURCE,
    piece: str = "1 hour",
    processing_time: str | None = None,
) -> StreamingQuery:
    """Stores the partial sessions of every batch; a batch that runs again replaces its own."""

    def action(batch: DataFrame, batch_id: int) -> None:
        replace_batch(partial_sessions(batch, gap, by, piece), batch_id, path)

    return each_batch(rows, action, checkpoint, processing_time)


def stored_sessions(spark: SparkSession, path: str, gap: str, by: Sequence[str] = SOURCE) -> DataFrame:
    """The sessions of everything that has arrived so far."""
    names = ", ".join(f"{c} string" for c in by)
    schema = (
        f"{names}, piece bigint, piece_us bigint, start timestamp_ntz, last timestamp_ntz, query_count bigint, "
        "known bigint, total_ms decimal(28,3), max_ms decimal(18,3), batch_id bigint"
    )
    return merged_sessions(spark.read.schema(schema).parquet(path).drop("batch_id"), gap, by)
