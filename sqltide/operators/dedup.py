"""Duplicates inside a batch and against the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXECUTION_KEY = ("source_db_type", "source_db_host", "sql_hash", "captured_at")
PATTERN_KEY = ("source_db_type", "source_db_host", "fingerprint")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key.

    Spark keeps one row per key in every map task before the shuffle, so a
    key with a third of all rows sends one row per task, not its whole group.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def _new_rows(batch: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    matches = [batch[k].eqNullSafe(known[k]) for k in keys]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    return batch.join(known, condition, "left_anti")


def dedup_executions(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Executions not in the store yet; the smallest id of equal ones.

    Statements that differ in literals only, started at the same time on one
    host, count as one execution, since the hash is of the pattern.
    """
    unique = first_per_key(batch, EXECUTION_KEY, [F.col("id")])
    return _new_rows(unique, store.select(*EXECUTION_KEY), EXECUTION_KEY)


def dedup_patterns(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Patterns not in the store yet; the slowest row of equal ones."""
    unique = first_per_key(batch, PATTERN_KEY, [F.col("duration_ms").desc(), F.col("id")])
    # The store holds a pattern many times.
    return _new_rows(unique, store.select(*PATTERN_KEY).distinct(), PATTERN_KEY)
