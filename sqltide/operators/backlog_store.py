"""A stored backlog that takes in new cases by rewriting only the buckets they fall into.

The rows lie in ``rows/version=V/bucket=B``; ``manifest/version=V`` names, for
every bucket, the version that holds it.  A run writes the changed buckets under
a new version first and the manifest, one small file, last.  Readers go by the
newest manifest, so a run that breaks off leaves the old table as it was, and its
rows are never seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide.operators.knowledge import CASE_KEY, with_fresh_cases
from sqltide.schemas import CASE
from sqltide.sources.store import durable

BUCKETS = 64
_MANIFEST = "bucket int, held bigint, buckets int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*CASE_KEY), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest manifest: which version holds each bucket; null before the first run."""
    try:
        every = spark.read.schema(f"{_MANIFEST}, version bigint").parquet(f"{path}/manifest")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    newest = every.agg(F.max("version")).first()[0]
    return None if newest is None else every.where(F.col("version") == newest)


def _held(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    """The rows of some buckets, each from the version that holds it; no more is listed or read."""
    if not versions:
        return spark.createDataFrame([], CASE)
    stored = T.StructType([*CASE.fields, T.StructField("version", T.LongType()), T.StructField("bucket", T.IntegerType())])
    by_version: dict[int, list[int]] = {}
    for bucket, version in versions.items():
        by_version.setdefault(version, []).append(bucket)
    wanted = reduce(
        lambda a, b: a | b,
        [(F.col("version") == v) & F.col("bucket").isin(own) for v, own in sorted(by_version.items())],
    )
    return spark.read.schema(stored).parquet(f"{path}/rows").where(wanted).select(*CASE.names)


def read_backlog(spark: SparkSession, path: str) -> DataFrame:
    """The stored cases; none before the first run."""
    found = manifest(spark, path)
    held = {} if found is None else {r["bucket"]: r["held"] for r in found.where("held >= 0").collect()}
    return _held(spark, path, held)


def stage_cases(fresh: DataFrame, path: str, buckets: int = BUCKETS) -> list[tuple[int, int, int, int]]:
    """Writes the buckets that ``fresh`` changes under a new version; returns the manifest that would make them seen.

    A case is in the store once, by pattern and type; a newer measurement
    replaces it and keeps its creation time.
    """
    spark = fresh.sparkSession
    known = manifest(spark, path)
    old: dict[int, int] = {}
    version = 0
    if known is not None:
        rows = known.collect()
        old = {r["bucket"]: r["held"] for r in rows}
        version, buckets = rows[0]["version"] + 1, rows[0]["buckets"]
    fresh = durable(fresh.select(*[F.col(f.name).cast(f.dataType) for f in CASE.fields]))
    # At most one row per bucket.
    touched = {r[0] for r in fresh.select(_bucket(buckets)).distinct().collect()}
    before = {b: v for b, v in old.items() if b in touched and v >= 0}
    merged = with_fresh_cases(fresh, _held(spark, path, before))
    placed = merged.withColumn("bucket", _bucket(buckets)).repartition("bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={version}")
    return [(b, version if b in touched else old.get(b, -1), buckets, version) for b in range(buckets)]


def publish(spark: SparkSession, path: str, entries: list[tuple[int, int, int, int]]) -> None:
    """Makes staged buckets seen: one file, written in one step."""
    version = entries[0][3]
    rows = spark.createDataFrame([e[:3] for e in entries], _MANIFEST).coalesce(1)
    rows.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def upsert_cases(fresh: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Puts new and newly measured cases into the stored backlog."""
    publish(fresh.sparkSession, path, stage_cases(fresh, path, buckets))
