"""Toxicity by non-negative positive-unlabelled learning.

Only toxic labels count; other texts, labelled or not, are unlabelled.  The
risk of calling unlabelled texts toxic is corrected by the share of toxic
texts, the class prior, and kept from falling below zero.  The classifier is
linear over how often words and word beginnings occur for the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide.llm.bpe import text_slices
from sqltide.llm.labelled import held_out, sample, training_labels
from sqltide.llm.shared import stored
from sqltide.llm.shingles import Words

SAMPLE = 20_000  # toxic texts, and unlabelled texts, to learn from, at most
THRESHOLD = 0.5
PREFIXES = (6, 7, 8, 9, 10)  # bytes of a word's beginning
FEATURES = 5_000  # features most telling of toxic texts
LEAST = 3  # toxic texts with a feature, at least
SHORT, POWER, SCALE = 50, 0.75, 30.0
LIFT = 3.0  # share among toxic texts over share among unlabelled ones, at least
ROUNDS, RATE, DECAY = 600, 0.1, 1e-5

_BLANK = np.ones(256, dtype=bool)
_BLANK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Features:
    """Distinct features of each text: hash of a word or word beginning, text, and density."""

    hash: np.ndarray
    owner: np.ndarray
    value: np.ndarray


def features(texts: list[str], known: np.ndarray | None = None) -> Features:
    """The features of texts, or those of them that are ``known`` (sorted; then by place in it).

    The value is the logarithm of one plus a density: occurrences over a power
    of the number of words, where a text counts as ``SHORT`` words at least.
    """
    words = Words(texts, _BLANK)
    n_words = np.diff(words.first)
    owner = np.repeat(np.arange(len(texts)), n_words)
    size = words.ends - words.starts
    hashes, owners = [words.hashes()], [owner]
    for n in PREFIXES:
        longer = size > n
        # A beginning is another feature than the word of the same bytes.
        hashes.append(words.hashes(n)[longer] ^ np.uint64(1))
        owners.append(owner[longer])
    found, of = np.concatenate(hashes), np.concatenate(owners)
    if known is not None:
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[at] == found
        found, of = at[hit], of[hit]
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(found)))
    value = np.log1p(SCALE * count / np.maximum(n_words[of[new]], SHORT) ** POWER)
    return Features(found[new], of[new], value)


@dataclass(frozen=True)
class Model:
    known: np.ndarray  # sorted feature hashes
    weight: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.known) and texts:
            found = features(texts, self.known)
            total += np.bincount(found.owner, found.value * self.weight[found.hash], len(texts))
        return 1 / (1 + np.exp(-total))


Row = tuple[np.ndarray, np.ndarray]  # feature hashes of a text and their values


def telling(seen: np.ndarray, toxic: np.ndarray, n_toxic: int, other: np.ndarray, n_other: int) -> np.ndarray:
    """The features, sorted, whose share among toxic texts is ``LIFT`` times that among unlabelled ones."""
    share, elsewhere = toxic / max(n_toxic, 1), (other + 1) / (n_other + 1)
    use = np.flatnonzero((toxic >= LEAST) & (share >= LIFT * elsewhere))
    use = use[np.lexsort((seen[use], elsewhere[use] - share[use]))][:FEATURES]
    return np.sort(seen[use])


def telling_of(toxic: list[Row], unlabelled: list[Row]) -> np.ndarray:
    """``telling`` features of texts that are at hand."""
    seen, n = np.unique(np.concatenate([f for f, _ in toxic]), return_counts=True)
    every, m = np.unique(np.concatenate([f for f, _ in unlabelled]), return_counts=True)
    other = np.zeros(len(seen), dtype=np.int64)
    both, at, where = np.intersect1d(seen, every, assume_unique=True, return_indices=True)
    other[at] = m[where]
    return telling(seen, n, len(toxic), other, len(unlabelled))


def fit(toxic: list[Row], unlabelled: list[Row], prior: float, known: np.ndarray | None = None) -> Model:
    """Minimises the non-negative risk on the logistic loss.

    The risk is prior * R(toxic as toxic) + max(0, R(unlabelled as clean) -
    prior * R(toxic as clean)).  While the second part is negative, its
    gradient is followed backwards, as it fits toxic texts among the unlabelled.
    Without toxic or unlabelled texts the score is the prior.
    """
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    flat = float(np.log(prior / (1 - prior)))
    if not toxic or not unlabelled:
        return Model(np.empty(0, np.uint64), np.empty(0), flat)
    if known is None:
        known = telling_of(toxic, unlabelled)
    if not len(known):
        return Model(known, np.empty(0), flat)

    def columns(rows: list[Row]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, value = (np.concatenate(x) for x in zip(*rows))
        owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[at] == found
        return owner[hit], at[hit], value[hit]

    toxic_table, unlabelled_table = columns(toxic), columns(unlabelled)
    theta = np.zeros(len(known) + 1)
    theta[-1] = flat
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def outputs(table: tuple, n: int) -> np.ndarray:
        row, column, value = table
        return np.bincount(row, value * theta[column], n) + theta[-1]

    def gradient(table: tuple, slope: np.ndarray) -> np.ndarray:
        row, column, value = table
        return np.append(np.bincount(column, value * slope[row], len(known)), slope.sum()) / len(slope)

    for step in range(1, ROUNDS + 1):
        p, u = outputs(toxic_table, len(toxic)), outputs(unlabelled_table, len(unlabelled))
        sp, su = 1 / (1 + np.exp(-p)), 1 / (1 + np.exp(-u))
        clean = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        clean_slope = gradient(unlabelled_table, su) - prior * gradient(toxic_table, sp)
        if clean >= 0:
            slope = prior * gradient(toxic_table, sp - 1) + clean_slope
        else:
            slope = -clean_slope
        slope[:-1] += DECAY * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(known, theta[:-1], float(theta[-1]))


def document_counts(texts: DataFrame) -> DataFrame:
    """In how many texts each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, run_texts in text_slices(batch.column(0)):
                each, n = np.unique(features(run_texts).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n)], ["feature", "n"])

    counts = texts.select("text").mapInArrow(run, "feature long, n long")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"))


def telling_among(texts: DataFrame, most: int = FEATURES) -> np.ndarray:
    """The ``most`` ``telling`` features of labelled texts; every feature is counted and judged on the executors."""
    counts = dict(texts.groupBy("label").count().collect())
    toxic = document_counts(texts.where("label = 1")).where(F.col("n") >= LEAST)
    other = document_counts(texts.where("label = 0")).withColumnRenamed("n", "m")
    share = F.col("n") / F.lit(float(max(counts.get(1, 0), 1)))
    elsewhere = (F.coalesce("m", F.lit(0)) + 1) / F.lit(float(counts.get(0, 0) + 1))
    judged = toxic.join(other, "feature", "left").select("feature", share.alias("share"), elsewhere.alias("elsewhere"))
    best = (
        judged.where(F.col("share") >= LIFT * F.col("elsewhere"))
        # Ties by the hash as an unsigned number, as in ``telling``.
        .orderBy(F.col("elsewhere") - F.col("share"), F.col("feature") < 0, "feature")
        .limit(most)
        .toPandas()
    )
    return np.sort(best["feature"].to_numpy(dtype=np.int64).view(np.uint64))


def known_features(texts: DataFrame, known: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Label, known features and values of each text, on the driver; in an order that does not vary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, run_texts in text_slices(batch.column(0)):
                found = features(run_texts, known)
                ends = np.concatenate([[0], np.cumsum(np.bincount(found.owner, minlength=len(run_texts)))])
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
                    for x in (found.hash.astype(np.int32), found.value.astype(np.float32))
                ]
                label = batch.column(1).slice(start, len(run_texts))
                yield pa.RecordBatch.from_arrays([*lists, label], ["found", "value", "label"])

    got = texts.select("text", "label").mapInArrow(run, "found array<int>, value array<float>, label int").toArrow()
    rows = [
        (y, known[np.asarray(f.values, dtype=np.int64)], np.asarray(v.values, dtype=np.float64))
        for f, v, y in zip(got.column("found"), got.column("value"), got.column("label").to_pylist())
    ]
    return sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))


def train(
    documents: DataFrame, labels: DataFrame, column: str = "toxic", limit: int = SAMPLE, most: int = FEATURES
) -> Model:
    """Learns from at most ``limit`` toxic and ``limit`` unlabelled texts outside the held-out fold.

    The unlabelled texts are a sample of all documents.  The prior is the share
    of toxic labels there, of ``documents`` only.  Features are taken, counted and judged where the
    texts are; the driver gets the ``most`` telling ones and, of the sample, their values.
    """
    own = labels.join(documents.select("doc_id"), "doc_id", "left_semi").select("doc_id", column)
    rows = own.where(F.col(column).isNotNull() & ~held_out(F.col("doc_id")))
    prior = rows.agg(F.avg((F.col(column) == 1).cast("double"))).first()[0] or 0.0
    toxic = training_labels(own.where(F.col(column) == 1), column, limit)
    others = sample(
        documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id"), limit
    ).withColumn("label", F.lit(0))
    # At most two times the limit, and so are the texts: of documents that repeat an id the least text counts.
    chosen = F.broadcast(toxic.union(others).distinct())
    picked = documents.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label")
    texts = stored(picked.agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "label"), "toxicity-sample")
    known = telling_among(texts, most)
    if not len(known):
        return fit([], [], prior)
    found = known_features(texts, known)
    return fit([(f, v) for y, f, v in found if y == 1], [(f, v) for y, f, v in found if y == 0], prior, known)


def scored(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the probability that the whole text is toxic; a column of that name is replaced.

    Null and empty texts have no features and get the score of the bias.  All
    rows and other columns are kept.
    """
    rest = df.drop(score)
    place = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(place)):
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(model.score(texts))], [*own.schema.names, score])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(score, T.DoubleType())]))


def scored_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity score and decision of every document."""
    model = train(documents, labels)
    return scored(documents.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
