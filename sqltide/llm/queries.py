"""The registered queries of this folder and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sqltide.llm import (
    bpe, chat, exact_dedup, line_dedup, near_dedup, packing, partenum, periodic_runs, quality, token_counts, toxicity,
    whitening, winnowing,
)

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counted_documents(table(spark, folder, "documents"), BYTE_BPE)


def op2_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, folder, "documents"), BYTE_BPE)


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), percent=85)


def op4_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.compared_documents(table(spark, folder, "documents"), without_id=True)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"), BYTE_BPE)


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.cleaned_documents(table(spark, folder, "documents"))


def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.formatted_conversations(table(spark, folder, "conversations"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"), keep="largest")


def op11_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.similar_documents(table(spark, folder, "documents"), percent=90)


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.described_documents(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_near_dedup": op3_near_dedup,
    "op4_winnowing": op4_winnowing,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_dedup": near_dedup.sql(85),
    "op7_line_dedup": line_dedup.SQL,
    "op8_chat_formatting": chat.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_ngram_jaccard_join": partenum.sql(90),
}
