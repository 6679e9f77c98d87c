"""Quality of texts: gradient-boosted trees over histograms of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide.llm.bpe import text_slices
from sqltide.llm.labelled import held_out, training_labels
from sqltide.llm.shingles import Words

SAMPLE = 20_000  # labelled rows to learn from, at most
THRESHOLD = 0.3

TREES, DEPTH, BINS, RATE, REGULAR, LEAST = 80, 4, 64, 0.15, 1.0, 5.0


def _classes() -> np.ndarray:
    """Byte classes whose shares are statistics, one column each."""
    groups = [
        range(48, 58), range(128, 256), b".,", b";:'\"()-?", b"!", b"|", b"#$%&*", b"@/\\_~^=+", b"<>[]{}`", b" ", b"\n", b"\t\r",
    ]
    table = np.zeros((256, len(groups)))
    for j, group in enumerate(groups):
        table[list(group), j] = 1
    return table


CLASSES = _classes()
NAMES = (
    "log_bytes", "log_words", "mean_word", "deviation_word", "long_words", "upper", "digits", "beyond_ascii",
    "stops", "marks", "exclamations", "bars", "symbols", "technical", "brackets", "spaces", "breaks", "controls",
    "distinct_words", "same_as_before", "distinct_threes", "commonest_word", "log_lines", "distinct_lines",
    "mean_line", "ends_in_stop",
)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of statistics per text; an empty text has zeros."""
    words = Words(texts)
    hashes, buffer = words.hashes(), words.buffer
    sizes = (words.ends - words.starts).astype(np.float64)
    last = buffer[words.ends - 1] if len(sizes) else buffer[:0]
    stop = (last == 46) | (last == 33) | (last == 63)
    out = np.zeros((len(texts), len(NAMES)))
    for i, text in enumerate(texts):
        a, b = int(words.origin[i]), int(words.origin[i + 1]) - 1
        if b == a:
            continue
        counts = np.bincount(buffer[a:b], minlength=256)
        n = b - a
        row = out[i]
        row[0] = np.log1p(n)
        row[5] = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n
        row[6:18] = counts @ CLASSES / n
        lines = text.split("\n")
        row[22], row[23], row[24] = np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines)
        f, t = int(words.first[i]), int(words.first[i + 1])
        m = t - f
        if not m:
            continue
        own, size = hashes[f:t], sizes[f:t]
        row[1], row[2], row[3], row[4] = np.log1p(m), size.mean(), size.std(), (size > 14).mean()
        ordered = np.sort(own)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        row[18], row[21] = (len(edges) - 1) / m, np.diff(edges).max() / m
        row[25] = stop[f:t].mean()
        if m > 1:
            row[19] = (own[1:] == own[:-1]).mean()
        if m > 2:
            threes = np.sort(own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7))
            row[20] = (1 + np.count_nonzero(threes[1:] != threes[:-1])) / (m - 2)
        else:
            row[20] = 1.0
    return out


@dataclass(frozen=True)
class Forest:
    """Complete trees in flat arrays: inner nodes by level, then leaves."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # goes right when the statistic is above
    leaf: np.ndarray  # trees x leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: all trees and rows walk down together."""
        n, trees = len(rows), np.arange(len(self.feature))
        if not n:
            return np.empty(0)
        at, which = np.zeros((n, len(trees)), dtype=np.int64), np.arange(n)[:, None]
        inner = self.feature.shape[1]
        while len(trees) and at[0, 0] < inner:
            right = rows[which, self.feature[trees, at]] > self.limit[trees, at]
            at = 2 * at + 1 + right
        total = self.base + self.leaf[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Boosts trees on the logistic loss.

    Statistics are cut into at most ``BINS`` bins at quantiles; a node takes the split
    with the greatest gain of its gradient histograms.  Without both labels
    there is nothing to split: the score is the smoothed share of label 1.
    """
    inner, width = 2**DEPTH - 1, rows.shape[1] if rows.ndim == 2 else len(NAMES)
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(labels)) < 2:
        empty = np.zeros((0, inner))
        return Forest(base, empty.astype(np.int64), empty, np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(rows[:, j], np.arange(1, BINS) / BINS)) for j in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * BINS
    features, limits, leaves = [], [], []
    total = np.full(len(labels), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, curvature = labels - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, BINS)
        at = np.zeros(len(labels), dtype=np.int64)
        for depth in range(DEPTH):
            low, nodes = 2**depth - 1, 2**depth
            cell = ((at - low)[:, None] * width * BINS + flat).ravel()
            shape = (nodes, width, BINS)
            g = np.bincount(cell, np.repeat(gradient, width), nodes * width * BINS).reshape(shape).cumsum(2)
            h = np.bincount(cell, np.repeat(curvature, width), nodes * width * BINS).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + REGULAR) + (g_all - g) ** 2 / (h_all - h + REGULAR) - g_all**2 / (h_all + REGULAR)
            gain[(h < LEAST / 4) | (h_all - h < LEAST / 4)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            useful = gain.reshape(nodes, -1).max(axis=1) > 1e-9
            feature[low : low + nodes] = best // BINS
            cut[low : low + nodes] = np.where(useful, best % BINS, BINS)
            right = binned[np.arange(len(at)), feature[at]] > cut[at]
            at = 2 * at + 1 + right
        leaf_of = at - inner
        g, h = (np.bincount(leaf_of, x, inner + 1) for x in (gradient, curvature))
        leaf = RATE * g / (h + REGULAR)
        total += leaf[leaf_of]
        limit = [cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(feature, cut)]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Forest(base, np.array(features), np.array(limits), np.array(leaves))


def train(documents: DataFrame, labels: DataFrame, column: str = "quality", limit: int = SAMPLE) -> Forest:
    """Learns from at most ``limit`` labelled documents outside the held-out fold.

    The statistics are taken where the texts are; the driver gets numbers of the
    sample only, one row for each label that was chosen: of documents that
    repeat an id the one with the least statistics.
    """
    chosen = training_labels(labels, column, limit).distinct()
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "label")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(0)):
                found = pa.array(list(statistics(texts)), pa.list_(pa.float64()))
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([found, own.column(1), own.column(2)], ["row", "doc_id", "label"])

    each = rows.mapInArrow(run, f"row array<double>, doc_id {kind}, label int")
    got = each.groupBy("doc_id", "label").agg(F.min("row").alias("row")).select("row", "label").collect()
    # Rows arrive in any order; sums of floats depend on it.
    got = sorted((tuple(r), y) for r, y in got)
    table = np.array([r for r, _ in got]).reshape(len(got), len(NAMES))
    return fit(table, np.array([float(y == 1) for _, y in got]))


def scored(df: DataFrame, forest: Forest, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the probability that the whole text is of good quality; a column of that name is replaced.

    Null and empty texts get the score of all statistics 0.  All rows and other columns are kept.
    """
    rest = df.drop(score)
    place = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(place)):
                own = batch.slice(start, len(texts))
                found = pa.array(forest.score(statistics(texts)))
                yield pa.RecordBatch.from_arrays([*own.columns, found], [*own.schema.names, score])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(score, T.DoubleType())]))


def scored_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality score and decision of every document."""
    forest = train(documents, labels)
    return scored(documents.select("doc_id", "text"), forest).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
