"""Classifiers: held-out accuracy, and their parts against plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import documents, table
from sqltide.llm import labelled, quality, toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))


def accuracy(scores, labels, column, fold):
    rows = scores.where(F.col("held_out") == fold).join(labels, "doc_id").select("predicted", column).collect()
    return sum(p == y for p, y in rows) / len(rows)


def test_quality_and_toxicity_on_the_held_out_fold(spark, given):
    docs, labels = given
    scores = quality.scored_documents(docs, labels)
    assert accuracy(scores, labels, "quality", True) >= 0.95
    found = toxicity.scored_documents(docs, labels)
    assert accuracy(found, labels, "toxic", True) >= 0.9
    assert scores.count() == found.count() == docs.count()
    held = {r.doc_id: r.held_out for r in found.collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())


def test_training_sample_is_bounded_and_held_in(spark):
    labels = spark.range(500).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(NULL AS int) AS toxic")
    chosen = {r.doc_id for r in labelled.training_labels(labels, "quality", 100).collect()}
    assert len(chosen) == 100 and all(zlib.crc32(str(i).encode()) % 5 for i in chosen)
    assert chosen == {r.doc_id for r in labelled.training_labels(labels.repartition(7), "quality", 100).collect()}
    assert labelled.training_labels(labels, "toxic", 100).collect() == []


def walk(forest, row):
    """One row down every tree, node by node."""
    total, inner = forest.base, forest.feature.shape[1]
    for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf):
        at = 0
        while at < inner:
            at = 2 * at + 1 + int(row[feature[at]] > limit[at])
        total += leaf[at - inner]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_a_walk_and_learn():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(2000, len(quality.NAMES)))
    rows[:, 3] = np.round(rows[:, 3])
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 3] > 0)).astype(float)
    forest = quality.fit(rows[:1500], labels[:1500])
    scores = forest.score(rows[1500:])
    assert ((scores >= 0.5) == labels[1500:]).mean() > 0.95
    assert np.allclose(scores[:50], [walk(forest, r) for r in rows[1500:1550]])


@pytest.mark.parametrize("labels,share", [([], 0.5), ([1.0, 1.0], 0.75), ([0.0] * 8, 0.1)])
def test_one_label_gives_its_share(labels, share):
    forest = quality.fit(np.zeros((len(labels), len(quality.NAMES))), np.array(labels))
    assert np.allclose(forest.score(np.zeros((3, len(quality.NAMES)))), share)


def test_statistics_of_odd_texts():
    rows = quality.statistics(["", "\n \n", "a", "Aa aa. aa", "é" * 10, "x " * 50_000])
    assert np.isfinite(rows).all() and not rows[0].any()
    named = dict(zip(quality.NAMES, rows[3]))
    assert named["upper"] == 1 / 9 and named["distinct_words"] == 2 / 3 and named["commonest_word"] == 2 / 3
    assert named["same_as_before"] == 0 and named["distinct_threes"] == 1.0
    assert quality.statistics([]).shape == (0, len(quality.NAMES))


def plain_features(text, known):
    """Score terms of one text by a loop over its words."""
    words, word = [], b""
    for b in text.encode().lower() + b" ":
        if b >= 128 or chr(b).isalpha():
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    found = {}
    for x in words:
        for f in [x, *(b"^" + x[:n] for n in toxicity.PREFIXES if len(x) > n)]:
            found[f] = found.get(f, 0) + 1
    scale = max(len(words), toxicity.SHORT) ** toxicity.POWER
    return sorted(np.log1p(toxicity.SCALE * c / scale) for c in found.values())


def test_features_equal_a_loop():
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab \n.!é1Z") for _ in range(draw.randrange(200))) for _ in range(50)] + ["", "longwordlongword again"]
    found = toxicity.features(texts)
    for i, text in enumerate(texts):
        assert np.allclose(np.sort(found.value[found.owner == i]), plain_features(text, None))


def test_unlabelled_learning_finds_hidden_positives():
    """Of the unlabelled texts a fifth is toxic; the labels tell none of them."""
    draw = random.Random(8)

    def text(bad):
        words = [draw.choice("abcdefghij") * draw.randrange(1, 9) for _ in range(40)]
        return " ".join(words + (draw.choices(["vile", "rotten", "awful"], k=2) if bad else []))

    def rows(texts):
        f = toxicity.features(texts)
        return [(f.hash[f.owner == i], f.value[f.owner == i]) for i in range(len(texts))]

    unlabelled = [text(i % 5 == 0) for i in range(400)]
    model = toxicity.fit(rows([text(True) for _ in range(100)]), rows(unlabelled), 0.2)
    scores = model.score(unlabelled + [text(False), text(True), ""])
    assert ((scores[:400] >= 0.5) == [i % 5 == 0 for i in range(400)]).mean() > 0.97
    assert scores[400] < 0.5 <= scores[401] and scores[402] < 0.5


def test_rare_telling_words_stand_beside_any_number_of_common_ones(spark):
    """Of 54,000 features in four toxic texts none is telling; a word in three others is."""
    draw = random.Random(2)
    common = " ".join("".join(draw.choices("abcdefghijklm", k=14)) for _ in range(9000))
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:40]
    texts = [common] * 16 + ["so vile"] * 3 + ["so plain"] * 21
    labels = spark.createDataFrame([(i, int(n < 4 or 16 <= n < 19)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, list(zip(ids, texts))), labels)
    assert model.known.tolist() == toxicity.features(["vile"]).hash.tolist()
    low, high = model.score(["so plain", "so vile"])
    assert low < high


def test_telling_features_counted_by_spark_equal_those_at_hand(spark):
    draw = random.Random(6)
    texts = [" ".join(draw.choice("abcdefgh") * draw.randrange(1, 12) for _ in range(30)) for _ in range(60)]
    texts = [t + " qq" * (i % 3 == 0) + " rrr" * (i % 6 == 0) for i, t in enumerate(texts)]
    found = [toxicity.features([t]) for t in texts]
    rows = [(f.hash, f.value) for f in found]
    df = spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in enumerate(texts)], "text string, label int")
    expected = toxicity.telling_of(rows[::3], [r for i, r in enumerate(rows) if i % 3])
    assert len(expected) and toxicity.telling_among(df).tolist() == expected.tolist()


def test_the_prior_and_the_sample_are_of_the_own_documents(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:200]
    docs = documents(spark, [(i, "vile" if n < 4 else f"plain text {n}") for n, i in enumerate(ids[:40])])
    labels = spark.createDataFrame([(i, int(n < 2 or n >= 40)) for n, i in enumerate(ids)], "doc_id long, toxic int")
    assert np.allclose(toxicity.train(docs, labels).score([""]), 2 / 40)
    # Toxic labels of other documents take no places in the sample.
    labels = labels.selectExpr("doc_id", f"int(doc_id IN ({', '.join(map(str, [*ids[:4], *ids[40:]]))})) AS toxic")
    assert len(toxicity.train(docs, labels, limit=40).known)


def test_without_examples_the_score_is_the_prior():
    assert np.allclose(toxicity.fit([], [], 0.25).score(["a", ""]), 0.25)


@pytest.mark.parametrize("scored", [quality.scored_documents, toxicity.scored_documents])
def test_odd_tables(spark, scored):
    texts = [None, "", "plain words", "z " * 20_000, (2, "plain words"), (None, "no id")]
    docs = documents(spark, texts).withColumnRenamed("lang", "score").withColumnRenamed("source", "label")
    labels = spark.createDataFrame(
        [(2, 1, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int"
    )
    rows = scored(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert scored(docs, labels).collect() == rows
    assert scored(docs.limit(0), labels.limit(0)).collect() == []
    assert all(0 <= r.score <= 1 for r in scored(docs, labels.limit(0)).collect())


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """One id on many rows is one document of the sample, for both classifiers."""
    rows = [(7, f"good text number {i} of many words") for i in range(300)] + [(8, "bad text"), (None, "no id")]
    df = documents(spark, rows).repartition(3)
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    seen = []
    plain = quality.fit
    monkeypatch.setattr(quality, "fit", lambda table, y: seen.append(len(table)) or plain(table, y))
    quality.train(df, labels, limit=2)
    plain_known = toxicity.known_features
    monkeypatch.setattr(toxicity, "telling_among", lambda texts, most: np.array([1], dtype=np.uint64))

    def counted(texts, known):
        found = plain_known(texts, known)
        seen.append(len(found))
        return found

    monkeypatch.setattr(toxicity, "known_features", counted)
    toxicity.train(df, labels, limit=2)
    assert seen[0] <= 2 and seen[1] <= 4
