"""Sets of word shingles, as 64-bit hashes, for runs of texts at once."""

from __future__ import annotations

import numpy as np

SIZE = 5  # words in a shingle
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


class Words:
    """The words of a run of texts: their places in one buffer, and hashes of their bytes.

    Words are runs of bytes that are not in ``blank`` (ASCII white space),
    A to Z in lower case.  ``first`` has where each text's words start, and one
    more; ``origin`` where its bytes start.
    """

    def __init__(self, texts: list[str], blank: np.ndarray = _BLANK):
        raw = [t.encode("utf-8").lower() for t in texts]  # bytes.lower changes A to Z only
        self.buffer = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blank[self.buffer]]).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.origin = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(self.starts, self.origin)
        up, self._down = _powers(len(self.buffer) + 1)
        terms = (self.buffer.astype(np.uint64) + np.uint64(1)) * up[: len(self.buffer)]
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``longest`` bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mixed((self._sums[ends] - self._sums[self.starts]) * self._down[self.starts] + (ends - self.starts).astype(np.uint64))


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; fewer words than ``size`` are one shingle, none an empty set."""
    found = Words(texts)
    words, first = found.hashes(), found.first
    weights = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        whole += words[j : j + len(whole)] * weights[j]
    whole = mixed(whole + np.uint64(size))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            few = words[a:b]
            out.append(mixed((few * weights[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def signature(shingles: np.ndarray, multipliers: np.ndarray, step: int = 4096) -> np.ndarray:
    """32-bit minhash values of a set that is not empty, one per multiplier."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), step):
        least = np.minimum(least, (shingles[a : a + step, None] * multipliers).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
