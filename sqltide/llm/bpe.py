"""BPE encoding and decoding with a public vocabulary."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide.llm import pretokens
from sqltide.llm.vocabulary import Vocabulary, load

MEMO = 150_000  # distinct pre-tokens remembered by a worker; beyond that it starts afresh
BATCH_CHARS = 1_000_000


def merge(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one pre-token.

    The symbols form a doubly linked list.  A heap holds the merge and the
    position of every adjacent pair that can merge, in one whole number, so
    the lowest rank comes first and the leftmost among equals.  A merge makes the
    pairs around it new; entries of pairs that are gone stay in the heap and
    are skipped when they come up.
    """
    of_byte, merge_of = vocabulary.byte_ids, vocabulary.merges.get
    ids = [of_byte[b] for b in piece]
    n = len(ids)
    heap = []
    for i in range(n - 1):
        found = merge_of(ids[i] << 20 | ids[i + 1])
        if found is not None:
            heap.append(found << 32 | i)
    if not heap:
        return ids
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i, found = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if ids[i] < 0 or j >= n or merge_of(ids[i] << 20 | ids[j]) != found:
            continue  # stale
        ids[i] = merged = found & 0xFFFFF
        ids[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = merge_of(merged << 20 | ids[k])
            if found is not None:
                heapq.heappush(heap, found << 32 | i)
        h = before[i]
        if h >= 0:
            found = merge_of(ids[h] << 20 | merged)
            if found is not None:
                heapq.heappush(heap, found << 32 | h)
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes batches of texts; distinct pre-tokens are merged once and remembered."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.memo: dict[bytes, bytes] = {}  # ids as 32-bit numbers
        self.memory = MEMO
        names = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at special strings: plain parts, id of the special after each or -1, part count."""
        if self.special is None or not any(s in t for s in self.vocabulary.special for t in texts):
            return texts, np.full(len(texts), -1), np.ones(len(texts), dtype=np.int64)
        parts, after, counts = [], [], []
        for text in texts:
            cut = self.special.split(text)
            parts += cut[::2]
            after += [self.vocabulary.special[s] for s in cut[1::2]] + [-1]
            counts.append(len(cut) // 2 + 1)
        return parts, np.array(after), np.array(counts)

    def ids_of(self, piece: bytes) -> bytes:
        found = self.memo.get(piece)
        if found is None:
            if len(self.memo) >= self.memory:
                self.memo.clear()
            found = array("i", merge(piece, self.vocabulary)).tobytes()
            if len(piece) <= 64:
                self.memo[piece] = found
        return found

    def lists(self, distinct: list[bytes]) -> list[bytes]:
        return [self.ids_of(p) for p in distinct]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (one more offset than texts)."""
        if not texts:
            return np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        parts, after, counts = self.units(texts)
        pieces = pretokens.split(parts)
        lists = self.lists(pieces.distinct)
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)) // 4
        flat = np.frombuffer(b"".join(lists), dtype=np.int32)
        origin = np.cumsum(sizes) - sizes
        n = sizes[pieces.codes]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(origin[pieces.codes] - total[:-1], n) + np.arange(total[-1])]
        ends = total[pieces.first[1:]]
        if (after >= 0).any():
            ids = np.insert(ids, ends[after >= 0], after[after >= 0].astype(np.int32))
            ends = ends + np.cumsum(after >= 0)
        offsets = np.concatenate([[0], ends[np.cumsum(counts) - 1]])
        return ids, offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def text_slices(column: pa.Array, most: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column in runs of bounded length (a long text is a run of its own); null: empty."""
    start, run, size = 0, [], 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        if run and size + len(text) > most:
            yield start, run
            start, run, size = i, [], 0
        run.append(text)
        size += len(text)
    if run:
        yield start, run


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of the whole text; a column of that name is replaced.

    Null and empty texts have no ids.  Strings of special tokens inside a text
    become their ids; nothing is added, cut or padded.  All other columns and
    repeated rows are kept.
    """
    rest = df.drop(ids)
    schema = T.StructType([*rest.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    place = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for batch in batches:
            for start, texts in text_slices(batch.column(place)):
                values, offsets = tool.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, lists], [*own.schema.names, ids])

    return rest.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of the token ids: their vocabulary strings, concatenated, as UTF-8.

    Special tokens are kept as their strings.  Bytes that are no UTF-8 become
    the replacement character.  Null ids give an empty text.
    """
    rest = df.drop(text)
    schema = T.StructType([*rest.schema.fields, T.StructField(text, T.StringType())])
    place = rest.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(path).tokens
        for batch in batches:
            column = batch.column(place)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            missing = column.is_null().to_pylist()
            out = []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                joined = b"" if missing[i] else b"".join([tokens[x] for x in values[a:b].tolist()])
                out.append(joined.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    return rest.mapInArrow(run, schema)


def bpe_round_trip(documents: DataFrame, path: str) -> DataFrame:
    """The digest of ids and decoded text of every document."""
    texts = documents.select("doc_id", "text")
    both = decode(encode(texts, path).drop("text"), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
