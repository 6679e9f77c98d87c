"""Periodic runs against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import time
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from llm.helpers import documents, table
from sqltide.llm import periodic_runs as pr


def brute_runs(word, least=6, repeats=4):
    """Every maximal stretch of each period, kept where no smaller period holds it."""
    n, found = len(word), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if word[i] != word[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and word[i] == word[i + q]:
                i += 1
            end = i + q
            if end - start >= max(least, repeats * q):
                found.setdefault((start, end - start), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_lyndon(word):
    n, out = len(word), []
    for i in range(n):
        out.append(max(k for k in range(1, n - i + 1) if all(word[i : i + k] < word[j : i + k] for j in range(i + 1, i + k))))
    return out


def words_of(draw):
    kind = draw.randrange(5)
    n = draw.randrange(40)
    if kind == 0:
        return [draw.randrange(2) for _ in range(n)]
    if kind == 1:
        return [draw.randrange(4) for _ in range(n)]
    out = []
    while len(out) < n:
        root = [draw.randrange(3) for _ in range(draw.randrange(1, 6))]
        out += root * draw.randrange(1, 7) + root[: draw.randrange(len(root))]
    return out


def test_lyndon_arrays():
    draw = random.Random(1)
    for _ in range(400):
        word = words_of(draw)[:25]
        assert pr.lyndon_array(word) == brute_lyndon(word), word


def test_runs_equal_brute_force():
    draw = random.Random(2)
    for _ in range(3000):
        word = words_of(draw)
        expected = brute_runs(word)
        assert sorted(pr.runs_of(word)) == expected, word
        assert sorted(pr.word_runs([b"%d" % w for w in word])) == expected, word


def test_other_limits():
    draw = random.Random(3)
    for _ in range(500):
        word = words_of(draw)
        assert sorted(pr.runs_of(word, 2, 2)) == brute_runs(word, 2, 2)


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        len(runs), best[0], best[1], best[2], best[1] and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_brute_force(spark):
    draw = random.Random(4)
    texts = [" ".join(f"w{w}" for w in words_of(draw)) for _ in range(300)]
    texts += [None, "", " \n\t", "one", "a a " * 9, "Ü ü " * 5, "x " * 6, "x " * 5, "x\x0by\x0cx\ry " * 4]
    texts += [" ".join(f"u{draw.randrange(400)}" for _ in range(300)) for _ in range(60)]
    rows = pr.described_documents(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:] == expected_row(r.doc_id, texts[r.doc_id])


def test_repeated_rows_nulls_and_clashing_columns(spark):
    df = documents(spark, [(None, "a " * 8), (None, None), (7, "a b " * 4), (7, "a b " * 4)])
    df = df.withColumns({"runs": F.lit(1), "collapsed": F.lit(2), "key": F.lit(3), "best": F.lit(4)})
    rows = pr.described_documents(df).collect()
    assert sorted((r.doc_id or 0, r.n_runs) for r in rows) == [(0, 0), (0, 1), (7, 1), (7, 1)]
    assert pr.described_documents(df.limit(0)).collect() == []


def test_real_outputs(spark):
    rows = table(pr.periodic_runs(documents(spark, ["say yes no yes no yes no yes no end"])))
    assert [tuple(r) for r in rows[0].runs] == [(1, 8, 2)]
    assert rows[0].collapsed == "say yes no end"


@pytest.mark.parametrize("text", ["a " * 400_000, "a b c " * 130_000 + "b " * 10_000, "b a " * 100_000 + "a b " * 100_000])
def test_long_texts_take_linear_time(text):
    words = text.encode().split()
    began = time.time()
    runs = pr.word_runs(words)
    assert runs and time.time() - began < 30
    assert pr.collapsed(words, runs)


def test_long_plain_text():
    draw = random.Random(5)
    words = [b"w%d" % draw.randrange(5000) for _ in range(300_000)]
    assert pr.word_runs(words) == []
