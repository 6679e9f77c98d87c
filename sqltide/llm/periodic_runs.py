"""Periodic runs of words: Lyndon arrays by suffix grouping, roots extended to runs.

Phase one of a linear suffix sorter groups the suffixes of a sequence by their
Lyndon prefixes: groups are taken from the greatest down, and each one moves the
nearest earlier suffixes of lower groups behind its own prefix.  When all groups
are done, the length of a suffix's group prefix is the longest Lyndon word that
starts there.  Done under the order of the words and under its reverse, this gives
the roots of every run; a root is extended to both sides by the longest common
extension of it and its next repetition.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.llm.bpe import text_slices

LEAST, REPEATS = 6, 4  # words in a run, and times its period, at least
CUTS = 8  # times a stretch is cut before it is searched as it is
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_array(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, symbols ordered by number.

    The end of the sequence is below every symbol.  ``group`` names the group of
    each suffix, ``members`` keeps a group's suffixes in text order (those that
    moved on since are skipped), and the groups form a list in their order.
    """
    n = len(word)
    symbols = sorted(set(word))
    number = {s: g for g, s in enumerate(symbols)}
    group = [number[s] for s in word]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    lower = list(range(-1, len(symbols) - 1))
    upper = [*range(1, len(symbols)), -1]
    length, earlier, done = [1] * n, [-1] * n, bytearray(n)
    current = len(symbols) - 1
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        members[current] = []
        if own:
            prefix = length[own[0]]
            heads: list[int] = []
            times: list[int] = []
            # The nearest earlier suffix of a lower group, and how many prefixes of this group follow it.
            for i in own:
                p = i - 1
                while p >= 0 and done[p]:
                    p = earlier[p]
                earlier[i] = p
                done[i] = 1
                if p >= 0:
                    if heads and heads[-1] == p:
                        times[-1] += 1
                    else:
                        heads.append(p)
                        times.append(1)
            levels = (1,) if not times or max(times) == 1 else sorted(set(times), reverse=True)
            for k in levels:
                moved: dict[int, int] = {}
                for p, t in zip(heads, times):
                    if t == k:
                        g = group[p]
                        to = moved.get(g)
                        if to is None:
                            # A new group right above the old one; more repetitions lie higher.
                            to = moved[g] = len(members)
                            members.append([])
                            lower.append(g)
                            upper.append(upper[g])
                            if upper[g] >= 0:
                                lower[upper[g]] = to
                            upper[g] = to
                        group[p] = to
                        members[to].append(p)
                        length[p] += k * prefix
        current = lower[current]
    return length


def _ahead(data: bytes, i: int, j: int, most: int) -> int:
    """How many symbols from ``i`` and from ``j`` on agree, at most ``most``; symbols have four bytes."""
    k, step, growing = 0, 1, True
    while k < most:
        step = min(step, most - k)
        if data[4 * (i + k) : 4 * (i + k + step)] == data[4 * (j + k) : 4 * (j + k + step)]:
            k += step
            step = step * 2 if growing else step
        elif step == 1:
            break
        else:
            growing = False
            step //= 2
    return k


def _back(data: bytes, i: int, j: int, most: int) -> int:
    """The same for the symbols before ``i`` and before ``j``."""
    k, step, growing = 0, 1, True
    while k < most:
        step = min(step, most - k)
        if data[4 * (i - k - step) : 4 * (i - k)] == data[4 * (j - k - step) : 4 * (j - k)]:
            k += step
            step = step * 2 if growing else step
        elif step == 1:
            break
        else:
            growing = False
            step //= 2
    return k


def runs_of(word: list[int], least: int = LEAST, repeats: int = REPEATS) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` symbols and ``repeats`` periods (two or more)."""
    n, found = len(word), set()
    if n < least:
        return found
    data = array("i", word).tobytes()
    for symbols in (word, [-s for s in word]):
        ends: dict[int, int] = {}  # of the last run of each period
        for i, p in enumerate(lyndon_array(symbols)):
            if p * repeats > n or i + p <= ends.get(p, 0):
                continue
            ahead = _ahead(data, i, i + p, n - i - p)
            start = i - _back(data, i, i + p, i)
            end = i + p + ahead
            if end - start >= 2 * p:
                ends[p] = end
                if end - start >= max(least, repeats * p):
                    found.add((start, end - start, p))
    return found


def stretches(word: np.ndarray) -> list[tuple[int, int]]:
    """Parts of the sequence outside of which there is no run of 6 words and 4 periods.

    In such a run every three consecutive words occur three times or more, so
    it lies within one stretch of triples that occur three times in it.
    """
    out, pending = [], [(0, len(word), 0)]
    while pending:
        a, b, depth = pending.pop()
        if b - a < LEAST:
            continue
        if depth == CUTS:
            out.append((a, b))
            continue
        part = word[a:b]
        size = int(part.max()) + 1
        code = part[:-1] * size + part[1:]
        if size > 1 << 20:
            code = np.unique(code, return_inverse=True)[1]
        _, place, counts = np.unique(code[:-1] * size + part[2:], return_inverse=True, return_counts=True)
        often = np.concatenate([[False], counts[place] >= 3, [False]])
        edges = np.flatnonzero(often[1:] != often[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s == b - a - 2:
                out.append((a, b))
            elif e - s >= LEAST - 2:
                pending.append((a + s, a + e + 2, depth + 1))
    return out


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    word = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(numbers) > n - LEAST + 1:  # the words of a run that repeat earlier ones are five or more
        return []
    found = []
    for a, b in stretches(np.array(word, dtype=np.int64)):
        found += [(a + s, length, p) for s, length, p in runs_of(word[a:b])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = compress(words, np.cumsum(change)[:-1] == 0)
    return b" ".join(words)


def periodic_runs(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per row: its id, ``runs`` (start, length, period; by start, then period) and the ``collapsed`` text.

    Words are runs of bytes that are not ASCII white space, compared exactly and
    numbered from 0.  A run has at least 6 words and 4 periods; ``collapsed``
    keeps the first period of each and joins the words by one space.
    ``rewrite`` may change the words of a text (by id) before that.  Null and
    empty texts have no runs and collapse to the empty text.  Repeated rows and
    rows without an id each give a row; other columns are not returned.  A text
    is held by one task, in memory proportional to its length.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                own = batch.column(0).slice(start, len(texts))
                runs, left = [], []
                for name, content in zip(own.to_pylist(), texts):
                    words = content.encode("utf-8").split()  # bytes.split cuts at ASCII white space
                    if rewrite is not None:
                        words = rewrite(name, words)
                    found = word_runs(words)
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    left.append(collapsed(words, found))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(runs, pa.list_(_RUN)), pa.array(left, pa.binary()).cast(pa.string())],
                    ["key", "runs", "collapsed"],
                )

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    ).select(F.col("key").alias(key), "runs", "collapsed")


def repeated_tail(key: object, words: list[bytes]) -> list[bytes]:
    """A tenth of the texts, chosen by the checksum of the id, with a tail that repeats; without an id: as it is."""
    if key is None or not words:
        return words
    check, n = crc32(str(key).encode()), len(words)
    if check % 10:
        return words
    drawn = check // 10
    a = drawn % n
    period = 1 + (n - a) // (3 + drawn % 8)
    return words[:a] + [words[a + i % period] for i in range(n - a)]


def longest(runs: Column) -> Column:
    """The run of greatest length; of equals the one with the smallest start, then period."""
    return F.array_max(
        F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )


def described_documents(documents: DataFrame) -> DataFrame:
    """Number of runs, the longest run and digests of the runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.col("best")
    return (
        periodic_runs(documents, rewrite=repeated_tail)
        .withColumn("best", longest(F.col("runs")))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-best["s"]).alias("start"),
            best["length"].alias("length"),
            (-best["p"]).alias("period"),
            F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
            F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
    )
