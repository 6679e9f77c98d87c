"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles.  Equal sets are one, whatever their
number.  Every set gets minhash values; a tree branches the sets of a node
into children by their values at coordinates that the node's path selects, so
that sets meet in a node only after agreeing on every step of a path.  Small
nodes are compared exhaustively on all minhash values; a node that stays dense
(its sets resemble each other) stops branching and counts as one whole.
Independent trees repeat this until the target recall is met.

What the trees find are candidates.  Their connected components, the clusters,
hold every link that was found; inside a cluster links are established exactly,
on full shingle sets (``families``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltide.llm import shingles
from sqltide.llm.bpe import text_slices
from sqltide.llm.components import components
from sqltide.llm.families import classes, in_runs, similar, stars, verified_links  # noqa: F401
from sqltide.llm.shared import stored

VALUES = 128  # minhash values of a set
BRANCHES = 2  # children that a set joins at each step
LEAF = 256  # sets compared exhaustively in one node
DENSE = 0.5  # chance to agree on a step, from which a node stops branching: at 1 / BRANCHES pairs that meet do not grow
STEPS = 3  # of a path from one level to the next, after the first one
DEPTH = 24


def trees_for(threshold: float, recall: float, branches: int = BRANCHES) -> int:
    """Independent trees after which a pair at the threshold is missed with chance 1 - recall.

    A pair leaves a tree when none of its paths goes on: the least fixed point
    of q = (1 - threshold + threshold * q) ** branches, found by iteration.
    """
    q = 0.0
    for _ in range(1000):
        q = (1 - threshold + threshold * q) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(q)))


def profiles(df: DataFrame, key: str, text: str) -> DataFrame:
    """Id, size, 128-bit digest and minhash values of each document's shingle set."""
    kind = df.schema[key].dataType.simpleString()
    names = ["id", "n", "digest", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = shingles.multipliers(VALUES)
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                sizes, digests, values = [], [], []
                for found in shingles.shingle_sets(texts):
                    sizes.append(len(found))
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    values.append(shingles.signature(found, factors).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(values, pa.binary()),
                    ],
                    names,
                )

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n long, digest binary, values binary"
    )


def children(rows: DataFrame, kind: str, steps: int = 1) -> DataFrame:
    """Each set's children under its node, so many steps down: child, node, set.

    A child is named by a hash of node, coordinate and minhash value.  The
    coordinates of a node are drawn by its name, distinct within the node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(-1, VALUES)

            def below(node: np.ndarray, left: int) -> Iterator[np.ndarray]:
                if not left:
                    yield node
                    return
                start = shingles.mixed(node) % np.uint64(VALUES)
                stride = shingles.mixed(node + np.uint64(1)) % np.uint64(VALUES // 2) * np.uint64(2) + np.uint64(1)
                for b in range(BRANCHES):
                    at = ((start + np.uint64(b) * stride) % np.uint64(VALUES)).astype(np.int64)
                    value = values[np.arange(len(at)), at].astype(np.uint64)
                    name = shingles.mixed(node + np.uint64(b + 2)) ^ (at.astype(np.uint64) << np.uint64(32) | value)
                    yield from below(shingles.mixed(name), left - 1)

            for name in below(batch.column(0).to_numpy().view(np.uint64), steps):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), batch.column(0), batch.column(1)], ["child", "node", "id"]
                )

    return rows.select("node", "id", "values").mapInArrow(run, f"child long, node long, id {kind}")


def alike(values: list[bytes], least: float) -> np.ndarray:
    """Which pairs of sets agree on at least this share of their minhash values."""
    table = np.frombuffer(b"".join(values), dtype="<u4").reshape(len(values), VALUES)
    return np.stack([(table == row).mean(axis=1) >= least for row in table])


def candidate_links(sets: DataFrame, threshold: float, trees: int) -> DataFrame:
    """Links between sets that may be similar; their components hold all similar pairs found.

    ``sets`` has ``id`` and ``values``.  Pairs of small nodes are taken five
    standard deviations of the minhash estimate below the threshold.  A level
    leaves its rows and its nodes; what meets in a small node of any level is
    compared at the end, the same members once.
    """
    kind = sets.schema["id"].dataType.simpleString()
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / VALUES)
    roots = F.explode(F.expr(f"transform(sequence(1, {trees}), t -> xxhash64(t))"))
    level = sets.select(roots.alias("node"), "id", "values")
    placed, small, whole = [], [], []
    for depth in range(0, DEPTH + 1, STEPS):
        rows = stored(children(level, kind, STEPS if depth else 1), "near-children")
        nodes = rows.groupBy("child", "node").agg(
            F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("members"), F.min("id").alias("head")
        ).where("size > 1")
        if depth:
            # Chance of sharing a child; a node that is dense is done as a whole.
            parents = nodes.groupBy("node").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("met"))
            dense = large.join(parents, "node").where(
                F.col("met") / (F.col("size").cast("double") * F.col("size")) >= (BRANCHES * DENSE) ** STEPS
            ).select("node", F.col("head").alias("top"))
            nodes = nodes.join(dense, "node", "left").select("child", "node", "size", "members", "head", "top")
        nodes = stored(nodes, "near-nodes")
        if depth:
            stop = nodes.where("top IS NOT NULL").select("node", "top").distinct()
            whole.append(rows.join(stop, "node").select(F.col("id").alias("a"), F.col("top").alias("b")))
            nodes = nodes.where("top IS NULL")
        placed.append(rows.select("child", "id"))
        small.append(nodes.where(F.col("size") <= LEAF).select("child", "size", "members", "head"))
        large = nodes.where(F.col("size") > LEAF).select(F.col("child").alias("node"), "size", "head")
        if large.isEmpty():
            break
        branching = rows.select(F.col("child").alias("node"), "id").join(large.select("node", "head"), "node")
        level = branching.join(sets.select("id", "values"), "id").select("node", "id", "values")
    else:
        whole.append(branching.select(F.col("id").alias("a"), F.col("head").alias("b")))
    once = reduce(DataFrame.union, small).groupBy("size", "members", "head").agg(F.min("child").alias("child")).select("child")
    compared = in_runs(
        reduce(DataFrame.union, placed).join(once, "child").join(sets.select("id", "values"), "id").select("child", "id", "values"),
        ["child"],
        lambda g: stars(g["id"], alike(g["values"], least)),
        f"a {kind}, b {kind}",
    )
    return reduce(DataFrame.union, whole, compared)


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, recall: float = 0.99999
) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of
    their distinct five-word shingles (A to Z in lower case, words between
    ASCII white space).  Fewer than five words are one shingle.  Null and
    empty texts have none and are linked with nothing.  ``component_id`` is the
    smallest id reachable by links; that document is kept.  A pair at the
    threshold is missed with a chance of at most 1 - ``recall``, the closer ones
    far less; links are exact.  Ids are taken as unique: rows that repeat an id
    are one document in the links, and a row with a null id is linked only to
    others of its set.  Other columns are not returned.
    """
    every = stored(profiles(df, key, text), "near-profiles")
    sets = stored(
        every.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.first("values").alias("values")),
        "near-sets",
    )
    found = components(candidate_links(sets, percent / 100, trees_for(percent / 100, recall)))
    members = found.select("id", F.col("component").alias("cluster"))
    linked = components(verified_links(df, members, key, text, percent))
    return classes(every, sets, linked, key)


def sql(percent: int) -> str:
    """The same by brute force: all pairs of documents that share a shingle."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT s.a, s.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) s
  JOIN sizes p ON p.doc_id = s.a JOIN sizes q ON q.doc_id = s.b
  WHERE 100 * shared >= {percent} * (p.n + q.n - shared)),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id, s.n"""
