"""Joins between queries, analyses and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.functions import text

PATTERN = ("fingerprint", "source_db_type", "source_db_host")


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of many rows with one ``table`` row per key.

    A key may hold a third of all rows.  Adaptive execution splits the shuffle
    partitions that it measures to be skewed and repeats the table's part for
    each, so other keys pay nothing.
    """
    return rows.join(table, list(keys))


def queries_with_analysis(q: DataFrame, a: DataFrame) -> DataFrame:
    """Left outer join, one analysis at most per query."""
    renamed = a.withColumnsRenamed({"id": "analysis_id", "slow_query_id": "id"})
    return q.join(renamed, "id", "left")


def high_impact_queries(q: DataFrame, a: DataFrame) -> DataFrame:
    renamed = a.withColumnsRenamed({"id": "analysis_id", "slow_query_id": "id"})
    return q.join(renamed.where(F.col("improvement_level").isin("HIGH", "CRITICAL")), "id")


def representative_query(q: DataFrame) -> DataFrame:
    """Id of the newest execution per pattern and source; the largest id of equal ones."""
    newest = F.max(F.struct("captured_at", "id"))
    return q.groupBy(*PATTERN).agg(newest.alias("n")).select(*PATTERN, F.col("n.id").alias("id"))


def schema_context(q: DataFrame, latest: DataFrame) -> DataFrame:
    """Per query the tables it reads, with row counts and index names.

    ``latest`` is the flat output of ``latest_db_metadata``.  A table that it
    lacks has nulls; a query without tables has an empty list.
    """
    source = ["source_db_type", "source_db_host", "source_db_name"]
    used = q.select(
        "id",
        *source,
        F.explode(text.extract_tables(text.decode_hex_sql(F.col("full_sql")))).alias("table_name"),
    )
    # One database and table may be read by a third of all queries.
    keys = [*source, "table_name"]
    known = lookup_join(used, latest, keys).select("id", "table_name", "row_count", "indexes")
    # All tables of all queries; a known one replaces its name alone.
    entry = F.when(F.col("table_name").isNotNull(), F.struct("table_name", "row_count", "indexes"))
    nothing = F.lit(None)
    named = q.select(
        "id",
        F.explode_outer(text.extract_tables(text.decode_hex_sql(F.col("full_sql")))).alias("table_name"),
        nothing.cast("bigint").alias("row_count"),
        nothing.cast("array<string>").alias("indexes"),
    )
    every = known.unionByName(named).groupBy("id", "table_name").agg(
        F.max("row_count").alias("row_count"), F.max("indexes").alias("indexes")
    )
    return every.groupBy("id").agg(F.sort_array(F.collect_list(entry)).alias("schema_context"))
