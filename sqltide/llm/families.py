"""Exact links inside clusters of candidate sets, without comparing all pairs of a cluster.

A cluster that one task can hold is compared in whole.  In a larger one, a
bounded sample gives a few hubs, sets that resemble the most others, and a
reference, the shingles that most of the sample have.  Every member is compared
with both, block by block.  What resembles a hub is one part with it, and so is
what differs from the reference so little that it must resemble the set nearest
to it.  Only sets of different parts are compared after that, and only those
that share one of their rarest differences from the reference: what all of a
family share is no difference.  The sample changes the work, never the links'
components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sqltide.llm import shingles
from sqltide.llm.bpe import text_slices
from sqltide.llm.idfilter import perhaps_in
from sqltide.llm.shared import stored

BLOCK = 64  # sets in a block
BLOCK_BYTES = 16_000_000
HUBS = 4
MEMBER, HUB, REFERENCE = 0, 1, 2


def in_runs(
    df: DataFrame, keys: list[str], handle: Callable[[dict[str, list]], list[tuple]], schema: str
) -> DataFrame:
    """Calls ``handle`` with the columns of each run of equal keys; it returns rows.

    The rows are shuffled and sorted by the keys and streamed, so a task holds one run at a time.
    """
    names = df.columns
    ordered = df.repartition(*keys).sortWithinPartitions(*keys)
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, {c: [] for c in names}, []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)]
                out.clear()
                yield pa.RecordBatch.from_arrays(columns, arrow.names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(names))]
            at = [names.index(k) for k in keys]
            for row in zip(*columns):
                own = tuple(row[i] for i in at)
                if own != current:
                    if current is not None:
                        out.extend(handle(held))
                        if len(out) >= 10_000:
                            yield from flush()
                    current, held = own, {c: [] for c in names}
                for c, value in zip(names, row):
                    held[c].append(value)
        if current is not None:
            out.extend(handle(held))
        yield from flush()

    return ordered.mapInArrow(run, schema)


def stars(ids: list, linked: np.ndarray) -> list[tuple]:
    """Links that join each connected part of a run: every member to the part's least id."""
    left, out = np.ones(len(ids), dtype=bool), []
    linked = linked | linked.T
    for first in sorted(range(len(ids)), key=lambda i: ids[i]):
        if not left[first]:
            continue
        # Not yet reached from the least id: its own part.
        edge = np.array([first])
        left[first] = False
        while len(edge):
            edge = np.flatnonzero(linked[edge].any(axis=0) & left)
            left[edge] = False
            out.extend((ids[i], ids[first]) for i in edge if ids[i] != ids[first])
    return out


def overlaps(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets and of all their intersections."""
    found = [np.frombuffer(s, dtype="<u8") for s in sets]
    n = np.array([len(s) for s in found], dtype=np.float64)
    every, owner = np.concatenate(found), np.repeat(np.arange(len(found)), n.astype(np.int64))
    _, codes, counts = np.unique(every, return_inverse=True, return_counts=True)
    # Only shingles of two sets or more add to an intersection; sums of ones below 2**24 are exact.
    common = np.flatnonzero(counts > 1)
    place = np.full(len(counts), -1)
    place[common] = np.arange(len(common))
    at, shared = place[codes], np.zeros((len(found), len(found)))
    width = max(1, 8_000_000 // max(1, len(found)))
    for a in range(0, len(common), width):
        use = (at >= a) & (at < a + width)
        table = np.zeros((len(found), min(width, len(common) - a)), dtype=np.float32)
        table[owner[use], at[use] - a] = 1
        shared += table @ table.T
    return n, shared


def similar(sets: list[bytes], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, exactly."""
    n, shared = overlaps(sets)
    return 100 * shared >= percent * (n[:, None] + n[None, :] - shared)


def chosen_hubs(cluster, ids: list, sets: list[bytes], percent: int) -> list[tuple]:
    """What a sample of a cluster tells: up to ``HUBS`` sets that resemble the most others, and a reference.

    The reference has the shingles of most of the sample, and for all shingles
    that two or more differ in, how many of the sample differ from it there.
    """
    linked = similar(sets, percent)
    left, out = np.ones(len(ids), dtype=bool), []
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    while len(out) < HUBS and left.any():
        gain = (linked & left).sum(axis=1)
        best = max(order, key=lambda i: gain[i])
        if gain[best] < 2 and out:
            break
        out.append((cluster, ids[best], HUB, sets[best]))
        left &= ~linked[best]
    every, counts = np.unique(np.concatenate([np.frombuffer(s, dtype="<u8") for s in sets]), return_counts=True)
    usual = 2 * counts > len(sets)
    differ = np.where(usual, len(sets) - counts, counts)
    keep = usual | (differ > 1)
    rows = np.zeros(int(keep.sum()), dtype=[("shingle", "<u8"), ("differ", "<u4"), ("usual", "u1")])
    rows["shingle"], rows["differ"], rows["usual"] = every[keep], differ[keep], usual[keep]
    return [*out, (cluster, None, REFERENCE, rows.tobytes())]


def against_hubs(run: dict[str, list], percent: int) -> list[tuple]:
    """Of each member of a block: cluster, id, size, the hubs it resembles, and how it differs from the reference.

    ``d`` is the number of shingles in which it differs, ``first`` those of them
    that are rarest among the cluster's differences, as many as matter: sets
    that are similar differ from each other in k shingles at most, and share
    the differences from the reference beyond that.
    """
    contents = dict(zip(run["role"], run["shingles"]))
    table = np.frombuffer(contents[REFERENCE], dtype=[("shingle", "<u8"), ("differ", "<u4"), ("usual", "u1")])
    known, usual = table["shingle"], table["usual"] == 1
    hubs = [(i, np.frombuffer(s, dtype="<u8")) for i, s, r in zip(run["id"], run["shingles"], run["role"]) if r == HUB]
    out = []
    for cluster, own, content, role in zip(run["cluster"], run["id"], run["shingles"], run["role"]):
        if role != MEMBER:
            continue
        found = np.frombuffer(content, dtype="<u8")
        n, links = len(found), []
        for name, other in hubs:
            place = np.minimum(np.searchsorted(other, found), len(other) - 1)
            shared = int((other[place] == found).sum())
            if 100 * shared >= percent * (n + len(other) - shared):
                links.append(name)
        held, more, often = np.zeros(len(known), dtype=bool), found, np.zeros(n, dtype=np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            met = known[place] == found
            held[place[met]] = True
            extra = ~(met & usual[place])
            more, often = found[extra], np.where(met, table["differ"][place], 0)[extra]
        lacks = usual & ~held
        differ = np.concatenate([more, known[lacks]])
        often = np.concatenate([often, table["differ"][lacks]])
        most = (n + 100 * n // percent) * (100 - percent) // (100 + percent)
        first = differ[np.lexsort((differ, often))][: most + 1].view(np.int64)
        if len(differ) <= most:
            # May be similar to another such set without a common difference: a mark after the last one.
            first = np.append(first, np.int64(0))
        out.append((cluster, own, n, len(differ), links, first))
    return out


def joined_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cluster's choices of centres, the part of every centre: the least centre that common sets lead to."""
    for batch in batches:
        out = []
        for cluster, met in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            names = sorted({x for centres in met for x in centres})
            holds = np.array([[x in centres for x in names] for centres in met], dtype=np.int64)
            part = dict(stars(names, holds.T @ holds > 0))
            out.extend((cluster, x, part.get(x, x)) for x in names)
        columns = zip(*out) if out else ([], [], [])
        kind = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in columns], ["cluster", "centre", "part"])


def between_parts(starred: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that the hubs leave open: to the set nearest the reference, and between parts.

    Sets that differ from the reference in d and e shingles differ from each
    other in d + e at most, and in d + e less twice their common differences.
    """
    most = lambda n, m: f"({n} + {m} - 2 * (({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}))"
    kind = starred.schema["id"].dataType.simpleString()
    nearest = starred.groupBy("cluster").agg(F.min(F.struct("d", "id", "n")).alias("near"))
    # A set's centres: the hubs that it resembles, and the nearest set if it must resemble that or is it.
    sure = F.expr(f"id = near.id OR d + near.d <= {most('n', 'near.n')}")
    centres = F.when(sure, F.array_append("links", F.col("near.id"))).otherwise(F.col("links"))
    # Stored, so that a large cluster's sets need not meet in one task for what follows.
    centred = stored(
        starred.join(nearest, "cluster").select("cluster", "id", "n", "d", "first", F.array_sort(F.array_distinct(centres)).alias("centres")),
        "near-centres",
    )
    # A cluster has few centres, so the distinct choices of them are few.
    met = centred.where(F.size("centres") > 0).groupBy("cluster").agg(F.collect_set("centres").alias("met"))
    parts = met.mapInArrow(joined_centres, f"cluster {kind}, centre {kind}, part {kind}")
    named = stored(
        centred.withColumn("centre", F.get("centres", F.lit(0))).join(parts, ["cluster", "centre"], "left")
        .select("cluster", "id", "n", "d", "first", F.coalesce("part", "id").alias("part")),
        "near-parts",
    )
    joined = named.where("id <> part").select(F.col("id").alias("a"), F.col("part").alias("b"))
    counted = named.groupBy("cluster", "part").agg(F.count("*").alias("sets"))
    main = counted.groupBy("cluster").agg(
        F.max_by("part", F.struct("sets", "part")).alias("main"), F.count("*").alias("parts")
    ).where("parts > 1")
    open_sets = named.join(main.select("cluster", "main"), "cluster")
    postings = open_sets.select("cluster", "id", "n", "d", "part", (F.col("part") != F.col("main")).alias("loose"), F.posexplode("first").alias("at", "shingle"))
    x, y = postings.where("loose").alias("x"), postings.alias("y")
    pairs = (
        x.join(
            y,
            F.expr("x.cluster = y.cluster AND x.shingle = y.shingle AND x.part <> y.part AND (NOT y.loose OR x.id < y.id)")
            & F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
            & F.expr(f"2 * (x.d - x.at) >= x.d + y.d - {most('x.n', 'y.n')}")
            & F.expr(f"2 * (y.d - y.at) >= x.d + y.d - {most('x.n', 'y.n')}"),
        )
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .distinct()
    )
    content = large.select("id", "shingles")
    both = pairs.join(content.toDF("a", "own"), "a").join(content.toDF("b", "other"), "b").select("a", "b", "own", "other")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for own, other in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(own.as_buffer(), dtype="<u8"), np.frombuffer(other.as_buffer(), dtype="<u8")
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * shared >= percent * (len(s) + len(t) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.union(both.mapInArrow(check, f"a {kind}, b {kind}"))


def verified_links(
    documents: DataFrame, members: DataFrame, key: str, text: str, percent: int, size: int = shingles.SIZE
) -> DataFrame:
    """Links (``a``, ``b``) inside clusters, on full sets: their components are those of all similar pairs of a cluster.

    ``members`` has ``id`` and ``cluster``, an id once.  Shingles are 64-bit hashes.
    """
    kind = members.schema["id"].dataType.simpleString()
    texts = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    texts = perhaps_in(texts, members).join(members, "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, found in text_slices(batch.column(2)):
                own = batch.slice(start, len(found))
                sets = pa.array([s.tobytes() for s in shingles.shingle_sets(found, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), sets], ["cluster", "id", "shingles"])

    sets = stored(
        texts.select("cluster", "id", "text").mapInArrow(read, f"cluster {kind}, id {kind}, shingles binary")
        .where(F.octet_length("shingles") > 0),
        "near-sets",
    )
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES))
    cut = stored(
        sets.groupBy("cluster").agg(blocks.cast("int").alias("blocks")).where("blocks > 1"), "near-blocks"
    )
    links = in_runs(
        sets.join(cut, "cluster", "left_anti"),
        ["cluster"],
        lambda g: stars(g["id"], similar(g["shingles"], percent)),
        f"a {kind}, b {kind}",
    )
    if cut.isEmpty():
        return links
    large = sets.join(cut, "cluster")
    drawn = Window.partitionBy("cluster").orderBy(F.xxhash64("id"), "id", "bytes")
    sample = (
        large.select("cluster", "id", F.octet_length("shingles").cast("long").alias("bytes"))
        .withColumn("nth", F.row_number().over(drawn))
        .where(F.col("nth") <= BLOCK)
        .withColumn("sum", F.sum("bytes").over(drawn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where((F.col("nth") == 1) | (F.col("sum") <= BLOCK_BYTES))
    )
    hubs = stored(
        in_runs(
            sets.join(sample.select("cluster", "id"), ["cluster", "id"], "left_semi"),
            ["cluster"],
            lambda g: chosen_hubs(g["cluster"][0], g["id"], g["shingles"], percent),
            f"cluster {kind}, id {kind}, role int, shingles binary",
        ),
        "near-hubs",
    )
    placed = large.select(
        "cluster", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", F.lit(MEMBER).alias("role"), "shingles"
    )
    # Hubs and reference meet every block of their cluster: a copy for each 64 sets.
    copies = hubs.join(cut, "cluster").select(
        "cluster", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "id", "role", "shingles"
    )
    starred = stored(
        in_runs(
            placed.union(copies),
            ["cluster", "block"],
            lambda g: against_hubs(g, percent),
            f"cluster {kind}, id {kind}, n long, d long, links array<{kind}>, first array<long>",
        ),
        "near-stars",
    )
    return links.union(between_parts(starred, sets, percent))


def classes(every: DataFrame, sets: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """One row per row of ``every`` (``id``, ``n``, ``digest``): id, ``n_shingles``, ``component_id`` and ``kept``.

    ``sets`` has the least ``id`` of each ``digest``, ``linked`` the component of ids with links.
    """
    of_set = sets.select("digest", "id").join(linked, "id", "left").select(
        "digest", F.coalesce("component", "id").alias("component")
    )
    return every.join(of_set, "digest", "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
