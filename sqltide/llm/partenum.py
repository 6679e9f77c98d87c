"""Set similarity join by PartEnum signatures.

Sets fall into bands of sizes; similar sets lie in one band or in neighbouring
ones, so each set takes part in its own band and the next.  For a band, the
threshold bounds the number k of elements in which two sets differ.  The feature
domain is cut into parts by hash, each part into smaller ones, so that at least
one part sees at most ``MISSES`` of the k differences; leaving out each choice of
that many smaller parts gives the signatures: a hash of the band, the part, the
choice and all elements in the smaller parts that stay.  Similar sets always
share a signature.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqltide.llm import shingles
from sqltide.llm.bpe import text_slices
from sqltide.llm.components import components
from sqltide.llm.families import classes, verified_links
from sqltide.llm.shared import stored

WORDS = 3  # in a shingle
MISSES, SMALLER = 1, 3  # differences that a part may see, and smaller parts in it
HELD = 1_000_000  # signatures that a task holds before it passes them on


def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band: the last is the greatest size that can be similar to the first."""
    first, last = [1], [100 // percent]
    while last[-1] < largest:
        first.append(last[-1] + 1)
        last.append(100 * first[-1] // percent)
    return np.array(first), np.array(last)


def parts_of(last: np.ndarray, percent: int) -> np.ndarray:
    """Parts of the domain for bands with these last sizes; none where similar sets are equal.

    Sets of at most ``last`` elements differ in k = 2 last (100 - percent) / (100 + percent) at most.
    """
    k = 2 * last * (100 - percent) // (100 + percent)
    return np.where(k > 0, -(-(k + 1) // (MISSES + 1)), 0)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, signature) of all sets, which are not empty."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    place, weight = shingles.mixed(every ^ np.uint64(0x5851F42D4C957F2D)), shingles.mixed(every + np.uint64(1))
    coarse, fine = place >> np.uint64(32), (place & np.uint64(0xFFFFFFFF)) % np.uint64(SMALLER)
    first, last = bands(percent, int(sizes.max()))
    first, last = np.append(first, last[-1] + 1), np.append(last, 100 * (last[-1] + 1) // percent)
    own = np.searchsorted(first, sizes, side="right") - 1
    owners, found = [], []
    for band in (own, own + 1):
        parts = parts_of(last[band], percent)
        offset = np.concatenate([[0], np.cumsum(parts)])
        use = parts[owner] > 0
        at, n = owner[use], parts[owner[use]]
        cell = (offset[at] + (coarse[use] % n.astype(np.uint64)).astype(np.int64)) * SMALLER + fine[use].astype(np.int64)
        content = np.zeros(int(offset[-1]) * SMALLER, dtype=np.uint64)
        np.add.at(content, cell, weight[use])
        content = content.reshape(-1, SMALLER)
        of_set = np.repeat(np.arange(len(sets)), parts)
        part = np.arange(int(offset[-1])) - offset[of_set]
        for number, kept in enumerate(combinations(range(SMALLER), SMALLER - MISSES)):
            name = (band[of_set] << 40 | part << 8 | number).astype(np.uint64)
            owners.append(of_set)
            found.append(shingles.mixed(content[:, kept].sum(axis=1) + shingles.mixed(name)))
    return np.concatenate(owners), np.concatenate(found)


def profiles(df: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """Id, size and 128-bit digest of each document's shingle set."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                sets = shingles.shingle_sets(texts, words)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                own = batch.column(0).slice(start, len(texts))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([own, sizes, pa.array(digests, pa.binary())], ["id", "n", "digest"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, n long, digest binary"
    )


def signature_links(df: DataFrame, key: str, text: str, percent: int, words: int = WORDS) -> DataFrame:
    """Links (``a``, ``b``) that join all documents with a common signature, not all pairs of them.

    A task links the documents that it holds to the first one of each
    signature and passes only that one on, so a signature that many documents
    share is small when it is shuffled; there its rows are linked in a row.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, owners, found, held, base = [], [], [], 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            ids = pa.chunked_array(names).combine_chunks()
            owner, signature = np.concatenate(owners), np.concatenate(found)
            order = np.argsort(signature, kind="stable")
            owner, signature = owner[order], signature[order]
            fresh = np.concatenate([[True], signature[1:] != signature[:-1]])
            lead = owner[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            pairs = np.unique(np.stack([owner, lead])[:, owner != lead], axis=1)
            none = pa.nulls(int(fresh.sum()), ids.type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signature[fresh].view(np.int64)), ids.take(pa.array(owner[fresh])), none], ["signature", "a", "b"]
            )
            # Links known here: each under a name of its own, so that it travels by itself.
            name = shingles.mixed(np.arange(pairs.shape[1], dtype=np.uint64) + signature[:1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), ids.take(pa.array(pairs[0])), ids.take(pa.array(pairs[1]))], ["signature", "a", "b"]
            )

        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                owner, signature = signatures(shingles.shingle_sets(texts, words), percent)
                names.append(batch.column(0).slice(start, len(texts)))
                owners.append(owner + base)
                found.append(signature)
                held, base = held + len(signature), base + len(texts)
                if held >= HELD:
                    yield from rows()
                    names, owners, found, held, base = [], [], [], 0, 0
        if held:
            yield from rows()

    named = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    spread = named.mapInArrow(run, f"signature long, a {kind}, b {kind}")
    met = Window.partitionBy("signature").orderBy("a")
    return (
        spread.withColumn("before", F.lag("a").over(met))
        .select("a", F.coalesce("b", "before").alias("b"))
        .where("a <> b")
    )


def similar_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 90, words: int = WORDS
) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of
    their distinct three-word shingles (A to Z in lower case, words between
    ASCII white space).  Fewer than three words are one shingle.  Null and
    empty texts have none and are linked with nothing.  No link is lost: similar
    sets share a signature, and links are exact, up to the 64 bits of a
    shingle's hash.  Equal sets are one set.  Ids are taken as unique: rows that
    repeat an id are one document in the links, and a row with a null id is
    linked only to others of its set.  Other columns are not returned.
    """
    every = stored(profiles(df, key, text, words), "join-profiles")
    sets = stored(
        every.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")), "join-sets"
    )
    clusters = components(signature_links(df, key, text, percent, words))
    # Of equal sets one is enough: the others are in its class already.
    members = stored(
        clusters.join(sets.select("id"), "id", "left_semi").select("id", F.col("component").alias("cluster")), "join-members"
    )
    linked = components(verified_links(df, members, key, text, percent, words))
    return classes(every, sets, linked, key)


def sql(percent: int) -> str:
    """The same by brute force: all pairs of documents that share a shingle."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
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
