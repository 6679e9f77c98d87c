"""The corpus pipeline: documents to packed sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltide.llm import exact_dedup, near_dedup, packing, quality, toxicity
from sqltide.llm.idfilter import without
from sqltide.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
NEAR_PERCENT = 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the threshold.  Learns from labelled documents of ``docs``."""
    forest = quality.train(docs, _labels(spark, sf_dir))
    return quality.scored(docs, forest).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches the threshold.  Learns from documents of ``docs``."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return toxicity.scored(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def _one_row_each(rows: DataFrame) -> DataFrame:
    """One row of each id and text, the least by its columns, where rows repeat an id."""
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return rows
    again = F.struct(*[F.col(c) for c in COLUMNS if c != "doc_id"])
    same = exact_dedup.lower_ascii(F.col("text")).alias("norm")
    kept = rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id", same).agg(F.min(again).alias("row"))
    return rows.join(repeated, "doc_id", "left_anti").select(*COLUMNS).union(kept.select("doc_id", "row.*"))


def _dropped(decisions: DataFrame) -> DataFrame:
    """The ids of which no row is kept."""
    rows = decisions.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    return rows.agg(F.bool_or("kept").alias("kept")).where("NOT kept").select("id")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, but for the case of A to Z, the one with the smallest id stays.

    Documents without an id cannot be told apart and stay.
    """
    dropped = stored(_dropped(exact_dedup.exact_groups(docs)), "pipeline-copies")
    return _one_row_each(without(docs.select(*COLUMNS), dropped, "doc_id"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays; those without an id stay."""
    dropped = stored(_dropped(near_dedup.near_duplicates(docs, percent=NEAR_PERCENT)), "pipeline-near-copies")
    return without(docs.select(*COLUMNS), dropped, "doc_id")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.packed_documents(docs, BYTE_BPE)


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("packing", packed_sequences),
]

# Trained classifiers and minhash values are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    Documents without an id take part in the classifiers only and are packed with the rest.
    """
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
