"""Whitening: its parts against numpy's dense routines, the query against a dense eigenvalue solver."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqltide.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def matrices():
    draw = np.random.default_rng(1)
    yield draw.normal(size=(40, 40))
    yield np.diag(10.0 ** -np.arange(12))
    yield draw.normal(size=(30, 30)) * 10.0 ** draw.uniform(-4, 4, 30)
    yield np.eye(8)
    yield np.outer(np.arange(1.0, 7), np.arange(2.0, 8))
    yield np.triu(np.ones((50, 50)))
    a = draw.normal(size=(20, 20))
    a[:, [3, 9]] = 0
    yield a
    q, _ = np.linalg.qr(draw.normal(size=(24, 24)))
    yield np.diag(np.repeat([3.0, 2.0, 1.0], 8)) @ q
    yield np.array([[5.0]])


@pytest.mark.parametrize("a", list(matrices()))
def test_right_vectors(a):
    values, vectors = wh.right_vectors(a, len(a))
    expected = np.linalg.svd(a, compute_uv=False)
    rank = len(values)
    assert rank == int((expected > 1e-13 * expected[0]).sum()) or rank <= len(a)
    assert np.allclose(np.sqrt(values), expected[:rank], rtol=1e-9, atol=1e-13 * expected[0])
    assert np.abs(vectors @ vectors.T - np.eye(rank)).max() < 1e-9
    assert np.allclose(np.linalg.norm(a @ vectors.T, axis=0), np.sqrt(values), rtol=1e-7, atol=1e-12 * expected[0])


def test_bidiagonal_form():
    a = np.random.default_rng(2).normal(size=(15, 15))
    diagonal, above, _ = wh.bidiagonal(a)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.allclose(np.linalg.svd(b, compute_uv=False), np.linalg.svd(a, compute_uv=False), rtol=1e-12)


def test_small_values_to_high_relative_accuracy():
    """A graded bidiagonal matrix: values down to 1e-12 of the greatest keep their digits."""
    n = 25
    diagonal, above = 2.0 ** -np.arange(0, 2 * n, 2.0), 2.0 ** -np.arange(0.0, 2 * n - 2, 2)
    values = np.sqrt(wh.squared_singular_values(diagonal, above))
    determinant = float(np.prod(diagonal))
    assert math.isclose(float(np.prod(values)), determinant, rel_tol=1e-12)


def expected(rows, components=16):
    usable = {}
    for i, (key, v) in enumerate(rows):
        if v is not None and v and all(c is not None and math.isfinite(c) for c in v):
            usable[i] = (key, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v))
    fit = sorted({x for _, x in usable.values()})
    n, x = len(fit), np.array(fit, dtype=np.int64)
    s = x.sum(axis=0)
    centred = (n * x - s) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors.T[::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    out = {}
    for i, (key, own) in usable.items():
        away = [n * a - int(b) for a, b in zip(own, s)]
        out[i] = (key, n, sum(d * d for d in away), (np.array(away) / n) @ vectors[:k].T / np.sqrt(values[:k]))
    return out, values[:k] / np.trace(v)


def test_query_equals_dense_solver(spark):
    draw = np.random.default_rng(3)
    width = 24
    mix = draw.normal(size=(width, width)) * 2.0 ** -np.arange(width)
    rows = [(i, [float(c) for c in draw.normal(size=width) @ mix + 3]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]  # copies
    rows += [(2000, None), (2001, [None] * width), (2002, [float("nan")] * width), (2003, [float("inf")] + [0.0] * (width - 1)), (2004, [])]
    rows += [(None, rows[1][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA).withColumns({"key": F.lit(1), "x": F.lit(2), "n": F.lit(3)})
    found = wh.whitened(df.repartition(7)).collect()
    by_row, share = expected(rows)
    assert len(found) == len(by_row) * 16
    by_key = {}
    for key, n, deviation, w in by_row.values():
        by_key[key] = (n, deviation, w)
    signs = None
    for r in found:
        n, deviation, w = by_key[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert math.isclose(r.explained, share[r.component - 1], rel_tol=1e-9)
        assert math.isclose(abs(r.whitened), abs(w[r.component - 1]), rel_tol=1e-6, abs_tol=1e-8)
        assert r.identity_error < 1e-9
    signs = {c: {round(r.whitened / by_key[r.vec_id][2][c - 1]) for r in found if r.component == c and abs(r.whitened) > 1e-6} for c in range(1, 17)}
    assert all(len(s) == 1 for s in signs.values())


def test_many_partitions_reduce_in_steps(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN_IN", 2)
    monkeypatch.setattr(wh, "BLOCK_BYTES", 400)
    draw = np.random.default_rng(4)
    rows = [(i, [float(c) for c in draw.normal(size=5)]) for i in range(300)]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA).repartition(9)
    found = wh.whitened(df).collect()
    by_row, _ = expected(rows)
    assert len(found) == 300 * 5
    for r in found:
        assert math.isclose(abs(r.whitened), abs(by_row[r.vec_id][3][r.component - 1]), rel_tol=1e-8, abs_tol=1e-9)


def test_edges(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 0) for i, v in enumerate(rows)], SCHEMA)
    assert wh.whitened(frame([])).collect() == []
    assert wh.whitened(frame([None, []])).collect() == []
    assert wh.whitened(frame([[1.0, 2.0]] * 5)).collect() == []  # one distinct vector has no spread
    two = wh.whitened(frame([[0.0, 1.0], [2.0, 1.0]])).collect()
    assert [(r.component, r.n, round(abs(r.whitened), 9), r.explained) for r in two] == [(1, 2, 1.0, 1.0)] * 2
    mixed = wh.whitened(frame([[0.0, 1.0], [2.0, 1.5], [1.0], [0.5, 9.0], [3e38, 1.0]])).collect()
    assert {r.vec_id for r in mixed} == {0, 1, 3}
    long = wh.whitened(frame([np.random.default_rng(i).normal(size=300).tolist() for i in range(40)])).collect()
    assert len(long) == 40 * 16 and max(r.identity_error for r in long) < 1e-9


def test_deviation_beyond_64_bits():
    x = np.array([[2**39, 0]], dtype=np.int64)
    assert wh.deviations(x, 10**9, np.array([0, 0])) == [None]
    assert wh.deviations(x // 2**20, 2, np.array([3, 1])) == [(2**20 - 3) ** 2 + 1]
