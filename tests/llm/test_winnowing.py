"""Winnowing against a plain reading of its definition."""

from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import documents, table
from sqltide.llm import winnowing as w


def brute(codes, k, window):
    """Positions of the rightmost least hash of every window, by definition."""
    grams = [codes[i : i + k] for i in range(len(codes) - k + 1)]
    if not grams:
        grams = [[*codes, *[0] * (k - len(codes))]] if codes else []
    hashes = []
    for gram in grams:
        value = 0
        for c in gram:
            value = (value * w.BASE + c) % w.PRIME
        hashes.append(value)
    if len(hashes) < window:
        windows = [range(len(hashes))] if hashes else []
    else:
        windows = [range(i, i + window) for i in range(len(hashes) - window + 1)]
    chosen = []
    for each in windows:
        best = min(each, key=lambda i: (hashes[i], -i))
        if best not in chosen:
            chosen.append(best)
    return [(hashes[i], i) for i in chosen]


def word_codes(spark, texts):
    words = sorted({x for t in texts for x in re.findall(r"\S{1,16}", t.lower())} | {"x"})
    df = spark.createDataFrame([(x,) for x in words], "w string")
    return {r.w: r.c for r in df.select("w", F.pmod(F.xxhash64("w"), F.lit(w.PRIME)).alias("c")).collect()}


@pytest.mark.parametrize("k,window", [(4, 8), (1, 1), (2, 4), (8, 2)])
def test_selected_hashes_equal_the_definition(spark, k, window):
    draw = random.Random(k)
    texts = [" ".join(draw.choice(["a", "b", "Lorem", "é"]) for _ in range(n)) for n in [*range(30), 300]]
    texts += ["y" * 100, "same " * 50, "\n\t ", "one"]
    codes = word_codes(spark, texts)
    out = w.with_fingerprint(documents(spark, texts), "text", "fp", k, window)
    got = table(out.select("doc_id", w.positions("fp").alias("at")))
    for i, text in enumerate(texts):
        expected = brute([codes[x] for x in re.findall(r"\S{1,16}", text.lower())], k, window)
        assert [(r.hash, r.position) for r in got[i].at] == expected


@pytest.mark.parametrize("k,window,units", [(4, 8, 12), (4, 8, 13), (4, 8, 50), (1, 1, 2), (2, 4, 7), (8, 2, 10)])
def test_pieces_change_nothing(spark, k, window, units):
    draw = random.Random(units)
    texts = [" \n ".join(draw.choice(["a", "b", "a", "Lorem", "é"]) for _ in range(n)) for n in [*range(45), 300]]
    texts += ["\t " + "same " * 50, "x" * 77 + " y", "".join(draw.choice("ab\U0001F600") for _ in range(130)), None, ""]
    codes = word_codes(spark, ["a b lorem é same x y \U0001F600"])
    at = w.positions("fp").alias("at")
    got = table(w.with_fingerprint(documents(spark, texts), "text", "fp", k, window, w.UNIT, units).select("doc_id", at))
    for i, text in enumerate(texts):
        # Runs are either of up to 5 characters or of more than 16.
        expected = [c for run in (text or "").lower().split() for c in ([run] if len(run) <= 16 else run)]
        assert [(r.hash, r.position) for r in got[i].at] == brute([codes[x] for x in expected], k, window), text


def test_op4_texts_of_ten_million_characters(spark):
    n = 10_000_000
    signs = np.array(list("abcdefghijklmnop"))
    text = "".join(signs[np.random.default_rng(3).integers(0, len(signs), n)])
    got = table(w.compared_documents(documents(spark, [(2, text), (1, "short")])))
    codes = word_codes(spark, [" ".join(signs)])
    values = np.array([codes[c] for c in signs])[np.frombuffer(text.encode(), np.uint8) - ord("a")]
    hashes = np.zeros(n - w.K + 1, dtype=np.int64)
    for i in range(w.K):
        hashes = (hashes * w.BASE + values[i : n - w.K + 1 + i]) % w.PRIME
    ranked = hashes * w.HIGH + (w.HIGH - 1 - np.arange(len(hashes)))
    least = np.lib.stride_tricks.sliding_window_view(ranked, w.WINDOW).min(axis=1)
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    expected = " ".join(f"{x // w.HIGH:x}@{w.HIGH - 1 - x % w.HIGH}" for x in least.tolist())
    assert got[2].n_chars == n and got[2].fingerprint == expected
    assert got[2].edited_sha256 == sha256((text[: n // 2] + "short").encode()).hexdigest()
    # The texts draw on few different hashes, so half of the text has most of them.
    assert got[2].near_edited > 0.9 and got[2].near_next == 0.0


def test_shared_passages_share_a_hash(spark):
    draw = random.Random(9)
    word = lambda: f"w{draw.randrange(10**6)}"
    rows = []
    for i in range(40):
        passage = [word() for _ in range(w.K + w.WINDOW - 1)]
        for side in (0, 1):
            before, after = ([word() for _ in range(draw.randrange(30))] for _ in range(2))
            rows.append((2 * i + side, " ".join(before + passage + after)))
    got = table(w.with_fingerprint(documents(spark, rows), "text", "fp").select("doc_id", w.hashes("fp").alias("h")))
    assert all(set(got[2 * i].h) & set(got[2 * i + 1].h) for i in range(40))


def test_units_are_words_and_characters_of_longer_runs(spark):
    texts = ["a" * 16 + " " + "b" * 17 + "\n" + "c d", "x" * 40, "e " * 3 + "\U0001F600" * 18, "w" * 17 + " one"]
    units = [["a" * 16, *"b" * 17, "c", "d"], [*"x" * 40], [*"eee", *"\U0001F600" * 18], [*"w" * 17, "one"]]
    codes = word_codes(spark, [" ".join(x) for x in units])
    got = table(w.with_fingerprint(documents(spark, texts), "text", "fp", unit=w.UNIT).select("doc_id", w.positions("fp").alias("at")))
    for i, each in enumerate(units):
        assert [(r.hash, r.position) for r in got[i].at] == brute([codes[x] for x in each], w.K, w.WINDOW)


def test_op4_unspaced_passages_share_a_hash_at_any_offset(spark):
    draw = random.Random(4)
    signs = lambda n: "".join(chr(draw.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    rows = []
    for shift in range(34):
        passage = signs(17 + shift)
        # The neighbour of 2 * shift + 1 is 2 * shift.
        rows += [(2 * shift, signs(40) + passage + signs(9)), (2 * shift + 1, signs(40 + shift) + passage + signs(5))]
    got = table(w.compared_documents(documents(spark, rows)))
    assert [s for s in range(34) if not got[2 * s + 1].near_next > 0] == []


TEXTS = {10: "a b c d e f", 3: None, 40: "", 41: "É😀xyz", 7: "p " * 3000, 8: "p " * 3000, 100: "one"}


@pytest.mark.parametrize("partitions", [1, 7])
def test_op4_rows(spark, partitions):
    df = documents(spark, list(TEXTS.items())).repartition(partitions)
    df = df.withColumnRenamed("lang", "fp").withColumnRenamed("source", "next")
    got = table(w.compared_documents(df))
    ids = sorted(TEXTS, reverse=True)
    for doc, following in zip(ids, [*ids[1:], ids[0]]):
        text, other = TEXTS[doc] or "", TEXTS[following] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc].near_edited <= 1 and 0 <= got[doc].near_next <= 1
    assert got[7].fingerprint == got[8].fingerprint == got[8].edited_fingerprint
    assert got[8].near_next == got[8].near_edited == 1.0
    assert got[3].fingerprint == got[40].fingerprint == ""


def test_one_repeated_and_no_rows(spark):
    alone = table(w.compared_documents(documents(spark, [(5, "a b c d")])))[5]
    assert alone.near_next == 1.0 and alone.edited_sha256 == sha256(b"a b a b"[:4] + b"a b").hexdigest()
    df = documents(spark, [(5, "a b"), (5, "a b"), (None, "lost")])
    assert {r.doc_id for r in w.compared_documents(df).collect()} == {5}
    assert w.compared_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize("partitions", [1, 7])
def test_one_row_for_each_repeated_row_and_row_without_id(spark, partitions):
    rows = [(5, "a b"), (5, "a b"), (5, "a b"), (5, "c d e f"), (9, "g"), (2, None), (None, "lost"), (None, "lost"), (None, "h i")]
    df = documents(spark, rows).repartition(partitions)
    out = w.compared_documents(df, without_id=True).collect()
    placed = documents(spark, [(i, t or "") for i, t in rows]).select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("b")
    )
    placed = sorted(placed.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.a, r.b), reverse=True)
    expected = Counter()
    for row, following in zip(placed, [*placed[1:], placed[0]]):
        half = len(row.text) // 2
        edited = row.text[: len(row.text) - half] + following.text[:half]
        expected[row.doc_id, len(row.text), sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == expected
    assert sum(r.near_next == 1.0 for r in out if r.n_chars == 3 and r.doc_id == 5) >= 2
    assert w.compared_documents(df).count() == 6


def test_no_python_in_the_plan(spark):
    plan = w.compared_documents(documents(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
