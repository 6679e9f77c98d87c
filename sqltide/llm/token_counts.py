"""Token counts of whole texts by compiled finite-state transducers.

Two transducers work one after the other.  The first cuts texts into
pre-tokens (``pretokens``): its chunk state maps compose by a parallel prefix
scan.  The second reads the bytes of a pre-token and emits, on each
transition, by how much the number of tokens of the prefix read so far
changes.  It is compiled as it is needed and kept by the worker.

What makes the second one finite: the last token of a prefix is the one token
that ends there, starts at a place p, and stays apart from the last token of
the prefix up to p when the two are encoded together.  So a state holds, for
every place from which the bytes read so far may still grow into a longer
token, the position in the vocabulary trie, the last token before the place,
and the token count up to there relative to now.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltide.llm import pretokens
from sqltide.llm.bpe import Encoder, merge, text_slices
from sqltide.llm.vocabulary import Vocabulary, load

MEMO = 150_000
STATES = 200_000  # compiled states kept by a worker; beyond that it compiles afresh
START = -1


class Trie:
    """All tokens that BPE can produce, by their bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [START]
        special = set(vocabulary.special.values())
        for i, token in enumerate(vocabulary.tokens):
            if i in special or not token:
                continue
            node = 0
            for b in token:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(START)
                node = self.children[node][b]
            self.token[node] = i


class State:
    __slots__ = ("items", "next")

    def __init__(self, items: tuple[int, ...]):
        self.items = items  # by threes: trie node, last token before, tokens up to there minus tokens now
        self.next: dict[int, tuple[State, int]] = {}


class CountTransducer:
    """Counts the tokens of pre-tokens; a transition carries the change of the count."""

    def __init__(self, path: str):
        self.vocabulary = load(path)
        self.trie = Trie(self.vocabulary)
        self.apart: dict[tuple[int, int], bool] = {}
        self.memo: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        first = (0, START, 0)
        self.first = State(first)
        self.states = {first: self.first}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are when they stand side by side."""
        key = left << 20 | right if left != START else right
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= STATES:
                self.apart.clear()
            tokens = self.vocabulary.tokens
            alone = left == START
            text = tokens[right] if alone else tokens[left] + tokens[right]
            found = merge(text, self.vocabulary) == ([right] if alone else [left, right])
            self.apart[key] = found
        return found

    def compile(self, state: State, byte: int) -> tuple[State, int]:
        """The transition of a state on a byte."""
        children, token, items = self.trie.children, self.trie.token, state.items
        grown, change, last = [], None, START
        for i in range(0, len(items), 3):
            child = children[items[i]].get(byte)
            if child is None:
                continue
            before, count = items[i + 1], items[i + 2]
            if change is None and token[child] != START and self.stays_apart(before, token[child]):
                change, last = count + 1, token[child]
            if children[child]:
                grown += (child, before, count)
        assert change is not None, "single bytes are tokens, so some token ends here"
        grown[2::3] = [count - change for count in grown[2::3]]
        items = (*grown, 0, last, 0)
        after = self.states.get(items)
        if after is None:
            after = self.states[items] = State(items)
        state.next[byte] = found = (after, change)
        return found

    def count(self, piece: bytes) -> int:
        found = self.memo.get(piece)
        if found is not None:
            return found
        state, total = self.first, 0
        for byte in piece:
            step = state.next.get(byte) or self.compile(state, byte)
            state = step[0]
            total += step[1]
        if len(self.states) > STATES:
            self.reset()
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(piece) <= 64:
            self.memo[piece] = total
        return total


class Counter:
    """Token counts of batches of texts."""

    def __init__(self, path: str):
        self.transducer = CountTransducer(path)
        self.units = Encoder(path).units

    def counts(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0, dtype=np.int64)
        parts, after, groups = self.units(texts)
        pieces = pretokens.split(parts)
        of_piece = np.array([self.transducer.count(p) for p in pieces.distinct], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(of_piece[pieces.codes])])
        of_part = np.diff(total[pieces.first]) + (after >= 0)
        ends = np.cumsum(groups)
        return np.diff(np.concatenate([[0], np.cumsum(of_part)[ends - 1]]))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds the token count of the whole text; a column of that name is replaced.

    Equal to the length of the tokenizer library's ids without added tokens.
    Null and empty texts count 0.  Rows, repeated ones too, and all other
    columns are kept.  There is no shuffle.
    """
    rest = df.drop(n_tokens)
    schema = T.StructType([*rest.schema.fields, T.StructField(n_tokens, T.LongType())])
    place = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            for start, texts in text_slices(batch.column(place)):
                own = batch.slice(start, len(texts))
                counts = pa.array(tool.counts(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([*own.columns, counts], [*own.schema.names, n_tokens])

    return rest.mapInArrow(run, schema)


def counted_documents(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds ``limit`` tokens."""
    sized = documents.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )
    return token_counts(sized, path).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
