"""Whitening of embeddings: QR by blocks, bidiagonal form, dqds, twisted factorisations.

Rows are centred exactly and reduced to triangles block by block, the triangles to
one of as many rows as a vector has entries.  Householder reflections make it
bidiagonal; the differential quotient-difference algorithm with shifts finds the
squared singular values one by one, each to high relative accuracy; a twisted
factorisation at each value gives its vector without solving iterations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.llm.shared import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
WIDEST = 2.0**40  # larger entries are treated as those that are not finite
BLOCK_BYTES = 16_000_000
FAN_IN = 16  # triangles reduced to one at a time
EPS = np.finfo(np.float64).eps
CLOSE = 1e-5  # relative gap of squared singular values below which their vectors are made orthogonal


def householder(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, beta, alpha): (I - beta v v') x has alpha first and zeros after it."""
    top = float(np.abs(x).max()) if len(x) else 0.0
    if top == 0.0 or not x[1:].any():
        return np.zeros_like(x), 0.0, float(x[0]) if len(x) else 0.0
    v = x / top
    length = math.sqrt(float(v @ v))
    alpha = -math.copysign(length, v[0])
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha * top


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal, superdiagonal and the reflections from the right of a square matrix's bidiagonal form."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    diagonal, above, right = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for i in range(d):
        v, beta, diagonal[i] = householder(a[i:, i].copy())
        if beta:
            a[i:, i + 1 :] -= np.outer(beta * v, v @ a[i:, i + 1 :])
        if i < d - 1:
            v, beta, above[i] = householder(a[i, i + 1 :].copy())
            right.append((v, beta))
            if beta:
                a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i + 1 :] @ v, beta * v)
    return diagonal, above, right


def _pass(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference step: new q, new e and the running differences d."""
    n = len(q)
    new_q, new_e, ds = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - shift
    for i in range(n - 1):
        ds[i] = d
        new_q[i] = s = d + e[i]
        t = q[i + 1] / s if s else math.inf
        new_e[i] = e[i] * t if e[i] else 0.0
        d = d * t - shift if d else -shift
    ds[-1] = new_q[-1] = d
    return new_q, new_e, ds


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Of one bidiagonal matrix without zeros on its two diagonals, falling.

    Without a shift the running differences d are the reciprocals of the
    diagonal of the inverse of B B', so 1 / sum(1 / d) is below the least
    value: a shift that never overshoots but for rounding, in which case it is
    made smaller.  When the last off-diagonal entry is negligible the last
    value is found and taken off.
    """
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    found, total = [], 0.0
    while q:
        if len(q) == 1:
            found.append(total + max(q[0], 0.0))
            break
        if e[-1] <= EPS * EPS * (total + q[-1]):
            found.append(total + max(q[-1], 0.0))
            q.pop()
            e.pop()
            continue
        q, e, ds = _pass(q, e, 0.0)
        if min(ds) <= 0.0:
            shift = 0.0
        else:
            shift = (1 - 4 * EPS * len(q)) / math.fsum(1 / d for d in ds)
        # A shift below the last digit of the values found so far changes nothing.
        while shift > EPS * total * 0.01:
            new_q, new_e, ds = _pass(q, e, shift)
            if min(ds) >= 0.0 and all(math.isfinite(x) for x in new_q):
                q, e, total = new_q, new_e, total + shift
                break
            shift *= 0.9 if shift > 0.5 * total else 0.5
        for i in range(len(e)):  # negligible anywhere: no longer coupled
            if e[i] <= EPS * EPS * (total + min(q[i], q[i + 1])) * 1e-3:
                e[i] = 0.0
        if 0.0 in e:
            cut = len(e) - 1 - e[::-1].index(0.0)
            if cut < len(e) - 1:
                tail = squared_parts(q[cut + 1 :], e[cut + 1 :])
                found += [total + x for x in tail]
                q, e = q[: cut + 1], e[:cut]
    return np.array(sorted(found, reverse=True))


def squared_parts(q: list[float], e: list[float]) -> list[float]:
    return squared_singular_values(np.sqrt(np.maximum(q, 0.0)), np.sqrt(np.maximum(e, 0.0))).tolist()


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float, twist: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(unit vector z, gamma): (B'B - value) z is zero but at the twist, where it is gamma.

    The factorisation from the top and the one from the bottom meet where the
    pivot gamma is least, or at the given place.
    """
    n = len(diagonal)
    d, low = diagonal**2, above / diagonal[:-1]
    tiny = np.finfo(np.float64).tiny * 2.0**60 + EPS * EPS * float(d.max())
    plus, s = np.zeros(max(n - 1, 0)), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        if abs(pivot) < tiny:
            pivot = -tiny
        plus[i] = d[i] * low[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - value
    minus, p = np.zeros(max(n - 1, 0)), np.zeros(n)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1]
        if abs(pivot) < tiny:
            pivot = -tiny
        t = d[i] / pivot
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(s + p + value)
    r = int(np.argmin(gamma)) if twist is None else twist
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
    top = float(np.abs(z).max())
    z /= top
    return z / math.sqrt(float(z @ z)), gamma


def block_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows: unit vectors of the falling ``values`` of one unreduced block, orthogonal to each other."""
    out: list[np.ndarray] = []
    first = 0  # of the values that lie close together
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLOSE * values[k - 1]:
            first = k
        z, gamma = twisted_vector(diagonal, above, float(value))
        if k > first:
            near = np.array(out[first:k])
            for twist in [None, *np.argsort(gamma)[1:]]:
                if twist is not None:
                    z, _ = twisted_vector(diagonal, above, float(value), int(twist))
                rest = z - near.T @ (near @ z)
                rest -= near.T @ (near @ rest)
                left = math.sqrt(float(rest @ rest))
                if left > 0.1:  # not the same vector again
                    break
            z = rest / left
        out.append(z)
    return np.array(out).reshape(len(values), len(diagonal))


def right_vectors(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest squared singular values of a square matrix, falling, and rows with its right vectors.

    Values that are zero to working precision are left out.
    """
    d = len(matrix)
    scale = float(np.abs(matrix).max()) if d else 0.0
    if scale == 0.0:
        return np.zeros(0), np.zeros((0, d))
    diagonal, above, right = bidiagonal(matrix / scale)
    norm = max(float(np.abs(diagonal).max()), float(np.abs(above).max()) if d > 1 else 0.0)
    # Entries below the rounding of the reflections: a zero on the diagonal, a cut beside it.
    diagonal = np.where(np.abs(diagonal) < EPS * EPS * norm, EPS * EPS * norm, diagonal)
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * norm) + 1).tolist(), d]
    found = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        for place, value in enumerate(squared_singular_values(diagonal[a:b], above[a : b - 1])):
            found.append((value, a, b, place))
    found.sort(key=lambda x: (-x[0], x[1], x[3]))
    least = (EPS * d) ** 2 * found[0][0]
    chosen = [x for x in found if x[0] > least][:most]
    by_block: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for at, (value, a, b, _) in enumerate(chosen):
        by_block.setdefault((a, b), []).append((at, value))
    vectors = np.zeros((len(chosen), d))
    for (a, b), own in by_block.items():
        z = block_vectors(diagonal[a:b], above[a : b - 1], np.array([v for _, v in own]))
        vectors[[at for at, _ in own], a:b] = z
    # Back through the reflections: each acts on the entries behind its own row.
    for i in range(len(right) - 1, -1, -1):
        v, beta = right[i]
        if beta:
            vectors[:, i + 1 :] -= np.outer(vectors[:, i + 1 :] @ v, beta * v)
    values = np.array([v for v, *_ in chosen]) * scale * scale
    return values, vectors


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: rows n, column sums, eigenvalues and rows of unit eigenvectors, trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened components, one column each."""
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean, from whole numbers: one rounding each."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 2**62:
        return (n * x - sums) / n
    whole = np.array([[n * int(v) - int(s) for v, s in zip(row, sums.tolist())] for row in x.tolist()], dtype=object)
    return (whole.reshape(x.shape) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of (n x - S) squared of each row, exactly; null where it is beyond 64 bits."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 2**62:
        away = n * x - sums
        most = int(np.abs(away).max(initial=0))
        if most * most * max(x.shape[1], 1) < 2**63:
            return (away * away).sum(axis=1).tolist()
    own = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [v if v < 2**63 else None for v in own]


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``x``: the scaled whole numbers of each usable vector, eight bytes each."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            rows, out = [], []
            # One cast for the batch; nulls inside become nan, which is not finite either.
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], dtype=np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < WIDEST))])
            whole = np.zeros(len(flat), dtype="<i8")
            fits = np.abs(flat) < WIDEST
            whole[fits] = np.floor(SCALE * flat[fits]).astype(np.int64) + SHIFT
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            for i in range(len(lists)):
                a, b = starts[i], starts[i + 1]
                if valid[i] and bad[a] == bad[b]:
                    rows.append(i)
                    out.append(whole[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], ["key", "x"])

    return df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInArrow(run, f"key {kind}, x binary")


def blocks(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of whole numbers in blocks of bounded size."""
    step = max(1, BLOCK_BYTES // (8 * width))
    for a in range(0, len(column), step):
        part = column.slice(a, step)
        yield a, np.frombuffer(b"".join(part.to_pylist()), dtype="<i8").reshape(len(part), width)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """``vectors``: distinct ``x`` of one width.  What reaches the driver has the size of one triangle, not of the rows."""

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for batch in batches:
            for _, x in blocks(batch.column(0), width):
                n += len(x)
                high, low = x >> 32, x & 0xFFFFFFFF
                total += high.sum(axis=0).astype(object) * 2**32 + low.sum(axis=0).astype(object)
        if n:
            whole = [n, *total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(v) for v in whole])], ["at", "total"])

    parts = vectors.select("x").mapInArrow(sums_of, "at int, total string")
    found = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    n = found.get(-1, 0)
    if not n:
        return Whitening(0, np.zeros(width, dtype=np.int64), np.zeros(0), np.zeros((0, width)), 0.0)
    exact = [found[i] for i in range(width)]
    sums = np.array(exact, dtype=np.int64 if max(map(abs, exact)) < 2**62 else object)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            for _, x in blocks(batch.column(0), width):
                held = triangle(np.vstack([held, centred(x, n, sums)]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, np.zeros((0, width))
        for batch in batches:
            for g, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if g != group:
                    if group is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])
                    group, held = g, np.zeros((0, width))
                held = triangle(np.vstack([held, np.frombuffer(r).reshape(-1, width)]))
        if group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    # A triangle for each task; then sixteen to one until few are left.
    level = stored(vectors.select("x").mapInArrow(reduce, "r binary"), "whitening-triangles")
    while (left := level.count()) > FAN_IN:
        dealt = level.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(math.ceil(left / FAN_IN)))).repartition("g")
        level = stored(
            dealt.sortWithinPartitions("g", "r").select("g", "r").mapInArrow(join, "r binary"), "whitening-triangles"
        )
    rest = [np.frombuffer(row["r"]).reshape(-1, width) for row in level.collect()]
    whole = triangle(np.vstack(sorted(rest, key=lambda r: r.tobytes())))
    square = np.zeros((width, width))
    square[: len(whole)] = whole
    values, directions = right_vectors(square, components)
    return Whitening(n, sums, values / n, directions, float((whole * whole).sum()) / n)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened fit rows' covariance minus the identity, measured on the rows."""
    k, width = len(model.values), model.vectors.shape[1]
    if not k:
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, first, rows = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            for _, x in blocks(batch.column(0), width):
                w = model(x)
                squares, first, rows = squares + w.T @ w, first + w.sum(axis=0), rows + len(w)
        if rows:
            places = np.arange(k * k + k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int64()), pa.array(np.concatenate([squares.ravel(), first]))], ["at", "total"]
            )

    parts = vectors.select("x").mapInArrow(products, "at long, total double")
    found = {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect()}
    sums = np.array([found[i] for i in range(k * k + k)])
    mean = sums[k * k :] / model.n
    covariance = sums[: k * k].reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per usable row and component, up to ``components``: ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``.

    A vector is usable unless it is null or has an entry that is null, not
    finite or at least 2**40.  Entry c becomes floor(64 c) + 1,000,000.  The fit
    is over each distinct vector once, whatever its copies.  Where vectors of
    several lengths occur, those of the most frequent length (of equals the
    greater) are used.  Directions whose variance is zero to working precision
    are no components, so constant vectors, a single one or an empty table give
    no rows; equal variances come in any rotation.  Repeated rows and rows
    without an id give their own rows; other columns are not returned.
    ``deviation`` is null where it does not fit 64 bits.  A triangle of a vector's
    length squared is held by every task and by the driver.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = whole_vectors(df, key, vector)
    schema = (
        f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    distinct = stored(rows.where(F.octet_length("x") > 0).select("x").distinct(), "whitening-vectors")
    common = distinct.groupBy(F.octet_length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    width = common["bytes"] // 8 if common else 0
    distinct = distinct.where(F.octet_length("x") == 8 * width)
    model = fit(distinct, width, components) if width else None
    error = identity_error(distinct, model) if model else None
    k = len(model.values) if model else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x in blocks(batch.column(1), width) if k else ():
                own, m = batch.column(0).slice(a, len(x)), len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        own.take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(model(x).ravel()),
                        pa.array(np.tile(model.values / model.trace, m)),
                        pa.array(np.full(m * k, error, dtype=np.float64)),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.where(F.octet_length("x") == 8 * max(width, 1)).mapInArrow(run, schema).withColumnRenamed("key", key)
