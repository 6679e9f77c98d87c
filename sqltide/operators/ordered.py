"""The previous row in time order, places and ranks in an order, for tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltide.sources.store import durable


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Adds the ``value`` of the previous row of the same key.

    A window over the key alone would put a hot key into one task.  The rows
    are range-partitioned on key and order instead, which cuts a hot key into
    even pieces; the last row of a piece is repeated at the start of the next
    piece of its key, so one window inside the pieces suffices.
    """
    ranged = durable(
        df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id())
    )
    last = F.max(F.struct(*order, F.col(value).alias("_value")))["_value"]
    # At most one row per key and piece.
    ends = ranged.groupBy("_piece", *keys).agg(last.alias(value))
    pieces = Window.partitionBy(*keys).orderBy("_piece")
    carried = ends.select(
        F.lead("_piece").over(pieces).alias("_piece"), *keys, value, F.lit(True).alias("_carried")
    ).where(F.col("_piece").isNotNull())
    rows = ranged.withColumn("_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy("_piece", *keys).orderBy(F.col("_carried").desc(), *order)
    return (
        rows.withColumn(name, F.lag(value).over(inside))
        .where(~F.col("_carried"))
        .select(*df.columns, name)
    )


def _pieces(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows cut into consecutive pieces of the order, kept so that both passes see the same ones."""
    return durable(df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()))


def _before(pieces: DataFrame, size: Column) -> dict[int, int]:
    """What lies before each piece: sums over one number per piece, of which there is one per partition."""
    sums, total = {}, 0
    for row in pieces.groupBy("_piece").agg(size.alias("n")).orderBy("_piece").collect():
        sums[row["_piece"]] = total
        total += row["n"]
    return sums


def _with_base(pieces: DataFrame, before: dict[int, int]) -> DataFrame:
    spark = pieces.sparkSession
    return pieces.join(spark.createDataFrame(list(before.items()), "_piece int, _base bigint"), "_piece")


def numbered(df: DataFrame, order: Sequence[Column], name: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Adds each row's place in the order, from 1; only places ``first`` to ``last`` are returned.

    The order must tell all rows apart.  Pieces that hold no wanted place are
    not sorted.
    """
    pieces = _pieces(df, order)
    before = _before(pieces, F.count(F.lit(1)))
    starts = sorted(before.values())
    if last is not None:
        ends = dict(zip(starts, [*starts[1:], float("inf")]))
        before = {p: b for p, b in before.items() if b < last and ends[b] >= first}
    inside = Window.partitionBy("_piece").orderBy(*order)
    placed = _with_base(pieces, before).withColumn(name, F.row_number().over(inside) + F.col("_base"))
    wanted = F.col(name) >= first if last is None else F.col(name).between(first, last)
    return placed.where(wanted).drop("_piece", "_base")


def dense_ranked(df: DataFrame, order: Column, value: str, name: str) -> DataFrame:
    """Adds the dense rank of each row by one column, without one task that sees all rows."""
    pieces = _pieces(df, [order])
    # A struct counts a null value as one.
    before = _before(pieces, F.count_distinct(F.struct(value)))
    inside = Window.partitionBy("_piece").orderBy(order)
    ranked = _with_base(pieces, before).withColumn(name, (F.dense_rank().over(inside) + F.col("_base")).cast("int"))
    return ranked.drop("_piece", "_base")
