"""BPE of many short pre-tokens at once, one merge each per step."""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

from sqltide.llm.bpe import Encoder, merge
from sqltide.llm.vocabulary import Vocabulary

WIDTHS = (8, 16, 32)  # bytes; longer pre-tokens are merged on their own
MEMO = 500_000  # distinct pre-tokens remembered by a worker
NONE = np.int64(1) << 60


class PairTable:
    """Rank and result of pairs of ids, looked up in arrays."""

    def __init__(self, vocabulary: Vocabulary):
        keys = np.fromiter(vocabulary.merges, dtype=np.int64, count=len(vocabulary.merges))
        values = np.fromiter(vocabulary.merges.values(), dtype=np.int64, count=len(keys))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(values[order], NONE)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair; ``NONE`` where there is no merge or no right side."""
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (right >= 0), self.values[at], NONE)


def merge_many(pieces: list[bytes], width: int, table: PairTable, byte_ids: np.ndarray) -> list[bytes]:
    """Ids, as 32-bit numbers, of each piece of at most ``width`` bytes.

    Every row takes its lowest merge, the leftmost among equals, in each step; rows
    without merges are done.
    """
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
    # One column of padding, so that the last pair has a right side.
    ids = np.full((len(pieces), width + 1), -1, dtype=np.int32)
    ids[:, :width] = np.where(np.arange(width) < sizes[:, None], byte_ids[raw], -1)
    best = table.merges(ids[:, :-1], ids[:, 1:])
    rows, column = np.arange(len(pieces)), np.arange(width + 1)
    done = [b""] * len(pieces)
    while len(rows):
        at = best.argmin(axis=1)
        here = np.arange(len(rows))
        found = best[here, at]
        ended = found >= NONE
        if ended.any():
            flat, step = ids[ended].tobytes(), 4 * (width + 1)
            ends = 4 * (ids[ended] >= 0).sum(axis=1)
            for i, (row, n) in enumerate(zip(rows[ended].tolist(), ends.tolist())):
                done[row] = flat[i * step : i * step + n]
            going = ~ended
            rows, ids, best, at, found = rows[going], ids[going], best[going], at[going], found[going]
            here = np.arange(len(rows))
            if not len(rows):
                break
        move = np.minimum(column + (column > at[:, None]), width)
        ids = np.take_along_axis(ids, move, axis=1)
        ids[:, -1] = -1
        ids[here, at] = found & 0xFFFFF
        best = np.take_along_axis(best, np.minimum(move[:, :-1], width - 1), axis=1)
        best[here, at] = table.merges(ids[here, at], ids[here, at + 1])
        before = np.maximum(at - 1, 0)
        best[here, before] = table.merges(ids[here, before], ids[here, before + 1])
        best[:, -1] = NONE
    return done


class LockstepEncoder(Encoder):
    """Encodes like ``Encoder``; the new pre-tokens of a batch are merged together."""

    def __init__(self, path: str):
        super().__init__(path)
        self.table = PairTable(self.vocabulary)
        self.byte_ids = np.array(self.vocabulary.byte_ids, dtype=np.int32)
        self.memory = MEMO

    def lists(self, distinct: list[bytes]) -> list[bytes]:
        out = [self.memo.get(p) for p in distinct]
        new = [i for i, ids in enumerate(out) if ids is None]
        if len(self.memo) + len(new) > self.memory:
            self.memo.clear()
        for low, high in zip((0, *WIDTHS), WIDTHS):
            own = [i for i in new if low < len(distinct[i]) <= high]
            if own:
                for i, ids in zip(own, merge_many([distinct[i] for i in own], high, self.table, self.byte_ids)):
                    out[i] = self.memo[distinct[i]] = ids
        for i in new:
            if out[i] is None:
                out[i] = array("i", merge(distinct[i], self.vocabulary)).tobytes()
        return out


@lru_cache(maxsize=2)
def lockstep_encoder(path: str) -> LockstepEncoder:
    return LockstepEncoder(path)
