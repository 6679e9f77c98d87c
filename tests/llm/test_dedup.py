"""Exact, near and passage duplicates against brute force."""

from __future__ import annotations

import random
import re
import string
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.helpers import documents, table
from sqltide.llm import components, exact_dedup, families, idfilter, line_dedup, near_dedup, shingles

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        out[draw.randrange(len(out))] = f"w{draw.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def family():
    """Near copies of a few texts with ever more edits, texts that share a passage, and copies."""
    draw = random.Random(11)
    vocabulary = [f"Word{i}" for i in range(2000)]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(4):
        base = [draw.choice(vocabulary) for _ in range(150)]
        rows += [" ".join(edited(draw, base, draw.randrange(6))) for _ in range(60)]
    rows += [" ".join(passage + [draw.choice(vocabulary) for _ in range(40)]) for _ in range(120)]
    rows += [rows[0].upper()] * 3 + [None, "", " \n", "one", "ONE", "a b c d", "a b c d e", "ü", "Ü", "x " * 3000, "x " * 3001]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_brute_force(spark, family, percent):
    rows = near_dedup.near_duplicates(documents(spark, family), percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_components(family, percent)
    assert len(rows) == len(family)


def test_dense_and_large_nodes(spark, family, monkeypatch):
    """Small nodes and blocks, so that branching, dense nodes and pairs of blocks all occur."""
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    rows = near_dedup.near_duplicates(documents(spark, family), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_components(family, 85)


def test_near_duplicates_of_repeated_null_and_no_rows(spark):
    text = "one two three four five six"
    df = documents(spark, [(3, text), (3, text), (7, text.upper()), (None, text), (None, "alone"), (5, None)])
    df = df.withColumn("component_id", F.lit(1)).withColumnRenamed("lang", "digest")
    rows = near_dedup.near_duplicates(df).collect()
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept, r.n_shingles) for r in rows)
    assert got == [(-1, -1, True, 1), (-1, 3, False, 2), (3, 3, True, 2), (3, 3, True, 2), (5, 5, True, 0), (7, 3, False, 2)]
    assert near_dedup.near_duplicates(df.limit(0)).collect() == []


def test_trees_reach_the_recall():
    assert near_dedup.trees_for(0.85, 0.99999) < near_dedup.trees_for(0.8, 0.99999) <= 6
    assert near_dedup.trees_for(0.85, 0.9) == 1


def test_a_family_below_the_threshold_takes_few_levels(spark, monkeypatch):
    """Sets that agree on half of their values never get dense; every level is a round of shuffles."""
    draw = np.random.default_rng(3)
    fresh = draw.integers(0, 1 << 32, (1500, near_dedup.VALUES), dtype=np.uint64).astype("<u4")
    values = np.where(draw.random(fresh.shape) < 0.7, fresh[:1], fresh)
    values[1400:] = values[1300:1400]
    levels = []
    kept = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, name: (levels.append(name), kept(df, name))[1])
    sets = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(values)], "id long, values binary")
    found = components.components(near_dedup.candidate_links(sets, 0.85, 2)).collect()
    of = {r.id: r.component for r in found}
    assert all(of[i] == of[i - 100] for i in range(1400, 1500))
    assert levels.count("near-children") <= 4


def test_nodes_of_the_last_level_are_whole(spark, family, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 4)
    monkeypatch.setattr(near_dedup, "DEPTH", 0)
    rows = near_dedup.near_duplicates(documents(spark, family), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_components(family, 85)


def test_centres_that_sets_have_in_common_are_one_part():
    met = [[[3, 5], [5, 9], [7]], [[2]], [[1, 4], [6, 8], [4, 6]]]
    batch = pa.RecordBatch.from_arrays([pa.array([10, 20, 30]), pa.array(met)], ["cluster", "met"])
    got = [tuple(r.values()) for out in families.joined_centres(iter([batch])) for r in out.to_pylist()]
    assert got == [(10, 3, 3), (10, 5, 3), (10, 7, 7), (10, 9, 3), (20, 2, 2), (30, 1, 1), (30, 4, 1), (30, 6, 1), (30, 8, 1)]


def test_stars_join_every_part_to_its_least_id():
    linked = np.zeros((7, 7), dtype=bool)
    for i, j in [(0, 3), (3, 6), (1, 4), (2, 2)]:
        linked[i, j] = True
    assert sorted(families.stars([70, 10, 20, 30, 40, 50, 60], linked)) == [(40, 10), (60, 30), (70, 30)]
    assert families.stars([], np.zeros((0, 0), dtype=bool)) == []


def test_shingles_are_sets_of_the_words():
    texts = ["A b\tc\x0bd e f", "a B c d e f", "a b c d e  f ", "a b c d", "", "x", "x y z", "é É"]
    found = [s.tolist() for s in shingles.shingle_sets(texts)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 2
    assert [len(s) for s in found[3:]] == [1, 0, 1, 1, 1]
    assert shingles.shingle_sets(["é"])[0] != shingles.shingle_sets(["É"])[0]
    assert shingles.shingle_sets([]) == []


def test_similar_counts_shared_shingles_exactly():
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 50), dtype=np.uint64)) for _ in range(40)]
    got = near_dedup.similar([s.tobytes() for s in sets], 50)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            shared = len(np.intersect1d(a, b))
            assert got[i, j] == (100 * shared >= 50 * (len(a) + len(b) - shared))


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 60), (60, 50), (3, 3)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    neighbours = defaultdict(set)
    for a, b in links:
        if a != b:
            neighbours[a].add(b)
            neighbours[b].add(a)
    expected = {}
    for start in sorted(neighbours):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in expected:
                expected[x] = start
                todo += neighbours[x]
    got = [(r.id, r.component) for r in components.components(df).collect()]
    assert dict(got) == expected and len(got) == len(expected)


def brute_groups(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        known = [x for x in groups[norm] if x is not None]
        best = keep(known) if known else None
        out.append((i, best, len(groups[norm]), i == best, sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


COPIES = [(1, "Abc"), (5, "aBC"), (3, "abc "), (4, "É"), (2, "é"), (9, None), (8, ""), (6, "abc"), (6, "abc"), (None, "ABC"), (None, "solo"), (10, "x" * 100_000)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, lambda t: F.md5(F.lit("all the same"))])
def test_exact_groups(spark, keep, hash_of):
    df = documents(spark, COPIES).withColumn("keep_id", F.lit(1)).withColumnRenamed("lang", "hash")
    rows = exact_dedup.exact_groups(df, keep=keep, hash_of=hash_of).collect()
    got = sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in rows), key=str)
    assert got == brute_groups(COPIES, min if keep == "smallest" else max)
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []


def brute_cleaned(rows, window=3):
    lines = {i: (t.split("\n") if t else []) for i, t in rows}
    seen, gone = set(), defaultdict(set)
    for i in sorted(lines):
        for p in range(len(lines[i]) - window + 1):
            passage = tuple(lines[i][p : p + window])
            if not "\n".join(passage).strip():
                continue
            if passage in seen:
                gone[i].update(range(p, p + window))
            seen.add(passage)
    return {i: ("\n".join(x for p, x in enumerate(lines[i]) if p not in gone[i]), len(lines[i]), len(gone[i])) for i in lines}


def test_passages_equal_brute_force(spark):
    draw = random.Random(2)
    rows = [(i, "\n".join(draw.choice("abcd ") for _ in range(draw.randrange(40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\nb"), (103, "\n" * 10), (104, "\n" * 10), (105, "same\ntext\nhere\nend"), (106, "same\ntext\nhere\nend"), (107, "q\n" * 3000)]
    got = table(line_dedup.without_repeated_passages(documents(spark, rows)))
    assert {i: (r.text, r.n_lines, r.n_removed) for i, r in got.items()} == brute_cleaned(rows)


def test_passages_keep_rows_and_columns(spark):
    df = documents(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc\nd")])
    df = df.withColumn("n_lines", F.lit(7)).withColumnRenamed("lang", "line").withColumnRenamed("source", "hash")
    out = line_dedup.without_repeated_passages(df)
    assert out.columns == ["doc_id", "text", "line", "hash", "n_chars", "n_lines", "n_removed"]
    got = sorted((r.doc_id or -1, r.text, r.n_removed) for r in out.collect())
    assert got == [(-1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "d", 3)]
    assert line_dedup.cleaned_documents(df.limit(0)).collect() == []


def test_the_filter_loses_no_row_and_drops_most_others(spark):
    rows = spark.range(20_000).union(spark.createDataFrame([(None,)], "id long")).select("id", F.lit("x").alias("text"))
    ids = spark.range(0, 20_000, 97)
    got = [r.id for r in idfilter.perhaps_in(rows, ids).collect()]
    assert set(range(0, 20_000, 97)) <= set(got) and len(got) < 300
    assert idfilter.perhaps_in(rows, spark.range(0)).collect() == []
    left = [r.id for r in idfilter.without(rows, ids, "id").collect()]
    assert sorted(left, key=str) == sorted({*range(20_000), None} - set(range(0, 20_000, 97)), key=str)


def test_a_full_filter_still_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(idfilter, "BITS", 2)
    rows = spark.range(100)
    assert sorted(r.id for r in idfilter.without(rows, spark.range(50), "id").collect()) == list(range(50, 100))


def test_passages_of_one_hash_are_compared(spark):
    draw = random.Random(4)
    rows = [(i, "\n".join(draw.choice("abc ") for _ in range(draw.randrange(25)))) for i in range(30)]
    one = lambda passage: F.unhex(F.md5(F.lit("all the same")))
    got = table(line_dedup.without_repeated_passages(documents(spark, rows), hash_of=one))
    assert {i: (r.text, r.n_lines, r.n_removed) for i, r in got.items()} == brute_cleaned(rows)


def test_passages_of_long_texts(spark):
    long = "\n".join(f"line {i} of a long text" for i in range(50_000))
    got = table(line_dedup.without_repeated_passages(documents(spark, [(1, long), (2, "a\n" + long), (3, "x" * 2_000_000)])))
    assert (got[1].n_removed, got[2].text, got[2].n_removed, got[3].n_removed) == (0, "a", 50_000, 0)
