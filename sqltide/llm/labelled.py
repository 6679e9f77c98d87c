"""Labelled rows for training: the fold that is held out, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(key: Column) -> Column:
    """Whether a row is kept for testing: crc32 of the id as text, modulo the folds, is 0.  Null ids are not."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def sample(rows: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of the id: the same on every run.

    The result is small by its limit and is broadcast where it is joined.
    """
    return rows.orderBy(F.xxhash64(key), key).limit(limit)


def training_labels(labels: DataFrame, column: str, limit: int, key: str = "doc_id") -> DataFrame:
    """Id and label of at most ``limit`` rows outside the held-out fold; null labels are not labels."""
    rows = labels.where(F.col(column).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    return sample(rows.select(key, F.col(column).cast("int").alias("label")), limit, key)
