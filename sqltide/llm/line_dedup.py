"""Removing repeated passages: windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.llm.idfilter import perhaps_in
from sqltide.llm.shared import stored

WINDOW = 3


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have none."""
    return F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def passage_hash(passage: Column) -> Column:
    return F.unhex(F.md5(passage))


def line_windows(df: DataFrame, key: str, text: str, window: int = WINDOW, hash_of=passage_hash) -> DataFrame:
    """Key, first line, lines and 128-bit hash of every window that is not blank."""
    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(0), F.size("lines") - window)).otherwise(
        F.array().cast("array<int>")
    )
    joined = F.transform(starts, lambda i: F.array_join(F.slice("lines", i + 1, window), "\n"))
    return (
        df.select(F.col(key).alias("key"), lines_of(F.col(text)).alias("lines"))
        .select("key", F.posexplode(joined).alias("line", "joined"))
        .where(F.col("joined").rlike(r"\S"))
        .select("key", "line", "joined", hash_of(F.col("joined")).alias("hash"))
    )


def covered_lines(
    df: DataFrame, key: str, text: str, window: int = WINDOW, hash_of=passage_hash
) -> DataFrame:
    """Per document, the first lines of its windows that occurred before.

    The first occurrence is the one with the smallest key, then line.  Hashes
    alone are counted first, combined before the shuffle; the lines of the
    windows whose hash repeats are then grouped and joined as they are, so that
    two passages of one hash stay two.  Of the other windows' lines none is
    shuffled, but for those that share a place in a bitmap.
    """
    windows = line_windows(df, key, text, window, hash_of)
    counted = windows.groupBy("hash").agg(F.count("*").alias("places")).where("places > 1")
    repeated = stored(counted.select(F.col("hash").alias("id")), "repeated-passages")
    again = perhaps_in(windows, repeated, "hash")
    first = again.groupBy("hash", "joined").agg(F.count("*").alias("places"), F.min(F.struct("key", "line")).alias("first"))
    met = again.join(first.where("places > 1").drop("places"), ["hash", "joined"])
    later = met.where(F.struct("key", "line") > F.col("first"))
    return later.groupBy("key").agg(F.collect_set("line").alias("repeats"))


def without_repeated_passages(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, hash_of=passage_hash
) -> DataFrame:
    """The rows with their text rid of passages that occur before, and line counts.

    A passage is ``window`` consecutive lines, compared exactly.  The first
    occurrence stays, by key and line; later ones go, and overlapping ones
    merge into one removed span.  Windows of blank lines and texts of fewer
    lines never go.  Null texts become empty.  Rows with a null key stay as
    they are; rows that repeat a key count as one document.  Adds ``n_lines``
    and ``n_removed``, in place of columns of these names.
    """
    found = covered_lines(df.where(F.col(key).isNotNull()), key, text, window, hash_of).select(
        F.col("key").alias("_key"), "repeats"
    )
    rest = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    joined = df.select(*rest).join(found, F.col(key) == F.col("_key"), "left").withColumn("_lines", lines_of(F.col(text)))
    covered = F.array_distinct(F.flatten(F.transform("repeats", lambda p: F.sequence(p, p + window - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered)
    cleaned = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    return joined.select(
        *[
            F.when(F.col("repeats").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(cleaned).alias(text)
            if c == text
            else F.col(c)
            for c in rest
        ],
        F.size("_lines").alias("n_lines"),
        F.when(F.col("repeats").isNull(), 0).otherwise(F.size(covered)).alias("n_removed"),
    )


def cleaned_documents(documents: DataFrame) -> DataFrame:
    """Lines, removed lines and the digest of the cleaned text of every document."""
    return without_repeated_passages(documents.select("doc_id", "text")).select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_removed").cast("long").alias("n_removed"),
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("text_sha256"),
    )


SQL = r"""
WITH split AS (
  SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN CAST([] AS varchar[]) ELSE string_split(text, chr(10)) END AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(0, len(lines) - 2)) AS line, lines FROM split WHERE len(lines) >= 3),
joined AS (
  SELECT doc_id, line, lines[line + 1] || chr(10) || lines[line + 2] || chr(10) || lines[line + 3] AS passage
  FROM windows),
ranked AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY passage ORDER BY doc_id, line) AS nth
  FROM joined WHERE regexp_matches(passage, '[^ \t\n\x0B\f\r]')),
covered AS (
  SELECT DISTINCT doc_id, unnest([line, line + 1, line + 2]) AS line FROM ranked WHERE nth > 1),
numbered AS (
  SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(lines) AS content FROM split),
kept AS (
  SELECT n.doc_id, string_agg(n.content, chr(10) ORDER BY n.line) FILTER (c.line IS NULL) AS text,
    count(c.line) AS n_removed
  FROM numbered n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.line = c.line GROUP BY n.doc_id)
SELECT s.doc_id, CAST(len(s.lines) AS bigint) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  CAST(length(coalesce(k.text, '')) AS bigint) AS n_chars_left, sha256(coalesce(k.text, '')) AS text_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id"""
