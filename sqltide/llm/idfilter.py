"""Keeping most texts out of a shuffle when few ids matter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24  # 2 MB, whatever the number of ids


def marked(rows: DataFrame, ids: DataFrame, key: str, mark: str) -> DataFrame:
    """Adds whether a row's key may be among the ``id`` of ``ids``: never false for one that is.

    The ids are hashed into a bitmap of fixed size, which is broadcast.  When
    it is full every row is marked; exact joins follow, so it only saves work.
    Null keys are not marked.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(BITS))
    bits = ids.where("id IS NOT NULL").select(place.alias("place")).groupBy(
        F.bitmap_bucket_number("place").alias("_bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
    own = F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(BITS)))
    placed = rows.withColumns({"_bucket": F.bitmap_bucket_number(own), "_bit": F.bitmap_bit_position(own)})
    met = placed.join(F.broadcast(bits), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    found = F.call_function("shiftright", byte.cast("int"), (F.col("_bit") % 8).cast("int")).bitwiseAND(1) == 1
    return met.withColumn(mark, F.coalesce(found, F.lit(False))).select(*rows.columns, mark)


def perhaps_in(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key may be among the ids."""
    return marked(rows, ids, key, "_mark").where("_mark").drop("_mark")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the ids, null keys included; only rows that may be are shuffled."""
    both = marked(rows, ids, key, "_mark")
    doubtful = both.where("_mark").join(ids.select(F.col("id").alias(key)), key, "left_anti")
    return both.where("NOT _mark").select(*rows.columns).union(doubtful.select(*rows.columns))
