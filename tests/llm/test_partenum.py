"""PartEnum signatures: every similar pair shares one; the join against brute force, also in small blocks."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import documents, table
from sqltide.llm import families, near_dedup, partenum

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_components(rows, percent, size):
    sets = {i: shingle_set(t, size) for i, t in rows}
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
    return {i: (len(sets[i]), top(i)) for i in sets}


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.randrange(3)
        out[at : at + (kind > 0)] = [] if kind == 1 and len(out) > 2 else [f"w{draw.randrange(10**6)}"]
    return out


@pytest.fixture(scope="module")
def rows():
    """Families around several texts, chains of edits, subsets, copies, and the smallest texts."""
    draw = random.Random(12)
    vocabulary = [f"Word{i}" for i in range(3000)]
    out = []
    for n in (20, 60, 150, 400):
        base = [draw.choice(vocabulary) for _ in range(n)]
        out += [" ".join(edited(draw, base, draw.randrange(1 + n // 20))) for _ in range(60)]
        chain = base
        for _ in range(25):
            chain = edited(draw, chain, max(1, n // 100))
            out.append(" ".join(chain))
    passage = [draw.choice(vocabulary) for _ in range(80)]
    out += [" ".join(passage + [draw.choice(vocabulary) for _ in range(draw.randrange(40))]) for _ in range(100)]
    out += [" ".join(passage[: 80 - i]) for i in range(12)]
    out += [out[0].upper()] * 3 + [None, "", " \n", "one", "ONE", "a b", "a b c", "a b c d", "ü", "Ü", "x " * 3000, "x " * 3001]
    draw.shuffle(out)
    return list(enumerate(out))


def test_similar_sets_share_a_signature():
    draw = random.Random(13)
    for percent in (80, 90, 95):
        for _ in range(150):
            n = draw.randrange(1, 300)
            union = [draw.getrandbits(64) for _ in range(n)]
            apart = n - -(-percent * n // 100)
            lost = draw.sample(range(n), apart)
            left = draw.randrange(apart + 1)
            a = np.array(sorted(x for i, x in enumerate(union) if i not in lost[:left]), dtype=np.uint64)
            b = np.array(sorted(x for i, x in enumerate(union) if i not in lost[left:]), dtype=np.uint64)
            if not len(a) or not len(b) or np.array_equal(a, b):
                continue
            owner, found = partenum.signatures([a, b], percent)
            assert set(found[owner == 0].tolist()) & set(found[owner == 1].tolist()), (percent, len(a), len(b))


def test_bands_hold_all_similar_sizes():
    for percent in (80, 90):
        first, last = partenum.bands(percent, 5000)
        band = lambda n: int(np.searchsorted(first, n, side="right")) - 1
        for n in range(1, 4000):
            assert band(100 * n // percent) - band(n) in (0, 1)


@pytest.mark.parametrize("percent", [90, 80])
def test_join_equals_brute_force(spark, rows, percent):
    found = partenum.similar_documents(documents(spark, rows).repartition(5), percent=percent).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, percent, 3)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize(("block", "hubs"), [(4, 4), (8, 1)])
def test_families_in_small_blocks(spark, rows, monkeypatch, block, hubs):
    """Clusters of many blocks, hubs that reach a part of them only, and links between parts."""
    monkeypatch.setattr(families, "BLOCK", block)
    monkeypatch.setattr(families, "HUBS", hubs)
    monkeypatch.setattr(partenum, "HELD", 1000)
    found = partenum.similar_documents(documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 90, 3)


def test_near_duplicates_in_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(families, "BLOCK", 4)
    found = near_dedup.near_duplicates(documents(spark, rows), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 85, 5)


def test_large_family_is_not_compared_in_pairs(spark, monkeypatch):
    """Near copies of one text: pairs that reach the exact check stay in proportion to the sets."""
    draw = random.Random(14)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(edited(draw, base, draw.randrange(12))) for _ in range(600)]
    checked = []
    plain = families.between_parts

    def counted(starred, sets, percent):
        out = plain(starred, sets, percent)
        checked.append(out.count())
        return out

    monkeypatch.setattr(families, "between_parts", counted)
    found = partenum.similar_documents(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(list(enumerate(texts)), 90, 3)
    assert sum(checked) < 20 * len(texts)


def test_repeated_null_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = documents(spark, [(3, text), (3, text), (1, text + " more"), (None, text), (None, None), (9, None)])
    df = df.withColumns({"n": F.lit(1), "a": F.lit(2), "signature": F.lit(3), "id": F.lit(4)})
    found = partenum.similar_documents(df).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found) == [
        (0, 0, 0), (0, 48, 1), (1, 49, 1), (3, 48, 1), (3, 48, 1), (9, 0, 9)
    ]
    assert partenum.similar_documents(df.limit(0)).collect() == []


def test_long_text(spark):
    text = " ".join(f"w{i % 70001}" for i in range(200_000))
    found = table(partenum.similar_documents(documents(spark, [text, text + " end", "w1 w2 w3 " * 1000])))
    assert [found[i].component_id for i in range(3)] == [0, 0, 2]
