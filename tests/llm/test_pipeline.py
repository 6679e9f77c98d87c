"""The corpus pipeline and the registered queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from llm.helpers import documents, table
from llm.test_dedup import LOWER, brute_components
from oracle_check import connect, differences
from sqltide.llm import packing, quality, shared, toxicity

SMALL = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "toxicity", "exact dedup", "MinHash near-dedup", "packing",
    ]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, over the small tables."""
    rows = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        rows.append(shared.stored(stage(spark, rows[-1], SMALL), "test"))
    return rows


def test_each_stage_decides_on_what_it_gets(spark, stages):
    start, good, clean, distinct, apart, pieces = stages
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for rows in (good, clean, distinct, apart):
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = quality.scored(start, quality.train(start, labels)).where("score >= 0.3")
    assert set(table(kept)) == set(table(good)) < set(table(start))
    kept = toxicity.scored(good, toxicity.train(good, labels)).where("score < 0.5")
    assert set(table(kept)) == set(table(clean)) < set(table(good))
    first = {}
    for i, r in sorted(table(clean).items()):
        first.setdefault((r.text or "").translate(LOWER), i)
    assert set(table(distinct)) == set(first.values())
    expected = brute_components([(i, r.text) for i, r in table(distinct).items()], corpus_pipeline.NEAR_PERCENT)
    assert set(table(apart)) == {i for i, (_, _, stays) in expected.items() if stays}
    whole = packing.packed_documents(apart, corpus_pipeline.BYTE_BPE)
    assert sorted(whole.collect()) == sorted(pieces.collect())


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in got.collect()} == set(table(stages[4]))
    assert got.agg(F.sum("length")).first() == stages[5].agg(F.sum("length")).first()


def test_stages_on_odd_tables(spark, tmp_path):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A B C"), (None, "a b c"), (3, None), (4, ""), (5, "x " * 30_000)]
    df = documents(spark, rows).withColumn("kept", F.lit(1)).withColumn("score", F.lit("s"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        if name == "exact dedup":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "5", "None"]
        if name == "MinHash near-dedup":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "3", "4", "5", "None"]
        assert stage(spark, df.limit(0), str(tmp_path)).collect() == []


def test_all_are_registered():
    names = registered.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", [n for n in registered.oracle_sql() if n.startswith("op")])
def test_against_sql(spark, name):
    odd = differences(registered.queries()[name](spark, SMALL), connect(SMALL), registered.oracle_sql()[name])
    assert odd is None
