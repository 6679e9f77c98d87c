"""Exact duplicates: 128-bit content hash, then the bytes themselves."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.llm.shared import stored


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, every other character as it is; null: empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: str = "smallest",
    normal=lower_ascii,
    hash_of=content_hash,
) -> DataFrame:
    """One row per row of ``df``: its id, the id that stays, the group's size and digest.

    Texts are equal when their bytes are equal after ``normal``.  They are
    grouped by ``hash_of`` and the text itself, so the aggregation compares
    bytes inside a hash group; copies are combined before the shuffle.  The
    row with the smallest (or ``largest``) id stays.  Null and empty texts
    form one group.  Rows that repeat an id and a text count singly and get
    the same result.  Ids that are null are never kept unless all are.
    """
    chosen = {"smallest": F.min, "largest": F.max}[keep]
    rows = df.select(F.col(key).alias("key"), normal(F.col(text)).alias("norm")).withColumn(
        "hash", hash_of(F.col("norm"))
    )
    classes = rows.groupBy("hash", "norm").agg(chosen("key").alias("keep_id"), F.count("*").alias("group_size"))
    digests = classes.withColumn("text_sha256", F.sha2("norm", 256))
    groups = stored(
        digests.groupBy("hash").agg(
            F.count("*").alias("texts"),
            F.max("keep_id").alias("keep_id"),
            F.max("group_size").alias("group_size"),
            F.max("text_sha256").alias("text_sha256"),
        ),
        "exact-dedup",
    )
    found = ["key", "keep_id", "group_size", "text_sha256"]
    alone = groups.where("texts = 1").drop("texts")
    result = rows.drop("norm").join(alone, "hash").select(*found)
    collided = groups.where("texts > 1").select("hash")
    if not collided.isEmpty():
        # Different texts with one hash: the text takes the place of the hash.
        result = result.union(
            rows.join(digests.join(collided, "hash", "left_semi"), ["hash", "norm"]).select(*found)
        )
    return result.select(
        F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW same AS (PARTITION BY norm)"""
