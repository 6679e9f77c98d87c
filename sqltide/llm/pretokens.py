"""Splitting texts into pre-tokens with a small transducer, whole batches at a time.

The pattern of byte-level BPE (contractions, letters, digits, other marks,
white space that leaves its last character to what follows) is a deterministic
transducer over twelve character classes.  A batch of texts is one long symbol
array, cut into chunks of equal length.  Each chunk gives a map from entry
state to exit state; the maps compose by a parallel prefix scan, which gives
every chunk its entry state; one more pass emits the boundaries.  The cost
is linear in the text, whatever the length of a text or of a pre-token.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd

# Character classes.
LETTER, SINGLE, E_, ELL, RV, NUMBER, SPACE, BLANK, QUOTE, OTHER, END = range(11)
SYMBOLS = 11
# States: what the characters since the last certain boundary are.
FRESH, WORD, DIGITS, MARKS, SPACE_1, BLANK_1, SPACES, BLANKS, APOSTROPHE, WANTS_E, WANTS_L = range(11)
STATES = 11
HERE, BEFORE = 1, 2  # a pre-token starts at this character, at the one before it

CHUNK = 64
BLOCK = 1 << 20
SEPARATOR = "\x00"


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """The class of every code point, asked from the tokenizer library's own engine.

    Its Unicode tables may differ from Python's.  No letters, numbers or
    spaces are assigned above plane 3, so those code points are not asked.
    """
    from tokenizers import Regex, pre_tokenizers

    points = [c for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    points = np.array(points)
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        inside = np.ones(len(points), dtype=bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            inside[a:b] = False
        table[points[inside]] = kind
    for characters, kind in (("stmd", SINGLE), ("e", E_), ("l", ELL), ("rv", RV), (" ", SPACE), ("'", QUOTE)):
        for c in characters:
            table[ord(c)] = kind
    return table


def _fresh(symbol: int) -> tuple[int, int]:
    """State and output of a symbol that starts a pre-token."""
    state = {NUMBER: DIGITS, SPACE: SPACE_1, BLANK: BLANK_1, QUOTE: APOSTROPHE, OTHER: MARKS, END: FRESH}
    return state.get(symbol, WORD), 0 if symbol == END else HERE


def _step(state: int, symbol: int) -> tuple[int, int]:
    letter = symbol in (LETTER, SINGLE, E_, ELL, RV)
    if symbol == END:
        return FRESH, BEFORE if state in (WANTS_E, WANTS_L) else 0
    if state == WORD:
        return (WORD, 0) if letter else _fresh(symbol)
    if state == DIGITS:
        return (DIGITS, 0) if symbol == NUMBER else _fresh(symbol)
    if state == MARKS:
        return (MARKS, 0) if symbol in (QUOTE, OTHER) else _fresh(symbol)
    if state in (SPACE_1, BLANK_1, SPACES, BLANKS):
        if symbol in (SPACE, BLANK):
            return SPACES if symbol == SPACE else BLANKS, 0
        after, _ = _fresh(symbol)
        joined = state in (SPACE_1, SPACES)
        if joined and symbol == QUOTE:
            after = MARKS  # the space and the apostrophe belong together: no contraction
        return after, (0 if joined else HERE) | (BEFORE if state in (SPACES, BLANKS) else 0)
    if state == APOSTROPHE:
        if symbol in (QUOTE, OTHER):
            return MARKS, 0
        if symbol == SINGLE:
            return FRESH, 0
        if symbol in (RV, ELL):
            return WANTS_E if symbol == RV else WANTS_L, 0
        return _fresh(symbol)
    if state in (WANTS_E, WANTS_L):
        if symbol == (E_ if state == WANTS_E else ELL):
            return FRESH, 0
        after, emitted = (WORD, 0) if letter else _fresh(symbol)
        return after, emitted | BEFORE
    return _fresh(symbol)


_TABLE = [_step(state, symbol) for symbol in range(SYMBOLS) for state in range(STATES)]
NEXT = np.array([t[0] for t in _TABLE], dtype=np.uint8)
EMIT = np.array([t[1] for t in _TABLE], dtype=np.uint8)


def entry_states(maps: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
    """Entry state of each chunk and the last exit state, from the chunks' state maps.

    Inclusive scan by doubling: after step d, row i is the composition of the
    maps of chunks i - 2d + 1 to i.
    """
    composed, d = maps.copy(), 1
    while d < len(composed):
        composed[d:] = np.take_along_axis(composed[d:], composed[:-d], axis=1)
        d *= 2
    exits = composed[:, entry]
    return np.concatenate([np.array([entry], dtype=np.uint8), exits[:-1]]), int(exits[-1])


def boundaries(symbols: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts.  ``symbols`` ends with END."""
    emitted = np.empty(len(symbols), dtype=np.uint8)
    state = FRESH
    every = np.arange(STATES, dtype=np.uint8)
    for start in range(0, len(symbols), BLOCK):
        block = symbols[start : start + BLOCK]
        chunks = -(-len(block) // CHUNK)
        padded = np.full(chunks * CHUNK, END, dtype=np.int16)
        padded[: len(block)] = block
        steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T) * np.int16(STATES)
        maps = np.broadcast_to(every, (chunks, STATES))
        for row in steps:
            maps = NEXT[row[:, None] + maps]
        # Padding stands only at the very end, where the state is FRESH already.
        lanes, state = entry_states(maps, state)
        out = np.empty((CHUNK, chunks), dtype=np.uint8)
        for j, row in enumerate(steps):
            at = row + lanes
            out[j] = EMIT[at]
            lanes = NEXT[at]
        emitted[start : start + len(block)] = out.T.reshape(-1)[: len(block)]
    here = (emitted & HERE).astype(bool)
    here[:-1] |= (emitted[1:] & BEFORE).astype(bool)
    return np.flatnonzero(here)


@dataclass
class Pieces:
    """The pre-tokens of a batch of texts: the distinct ones, and which one stands where."""

    distinct: list[bytes]
    codes: np.ndarray  # index into distinct, in text order
    first: np.ndarray  # text i has the pieces first[i] to first[i + 1]


def _factorized(
    buffer: bytes, starts: np.ndarray, lengths: np.ndarray, plain: bool
) -> tuple[list[bytes], np.ndarray]:
    """Distinct byte strings.  Short ones are compared as one or two whole numbers."""
    codes = np.empty(len(starts), dtype=np.int64)
    distinct: list[bytes] = []
    words = np.ndarray((len(buffer) - 15,), dtype="<u8", buffer=buffer, strides=(1,))
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
    short = (lengths <= 8) & plain
    middle = (lengths > 8) & (lengths <= 16) & plain
    if short.any():
        got, values = pd.factorize(words[starts[short]] & masks[lengths[short]])
        codes[short] = got
        distinct += [x.rstrip(b"\x00") for x in np.asarray(values).astype("<u8").view("S8").tolist()]
    if middle.any():
        at, n = starts[middle], lengths[middle]
        low, lows = pd.factorize(words[at])
        high, highs = pd.factorize(words[at + 8] & masks[n - 8])
        got, pairs = pd.factorize(low * np.int64(len(highs)) + high)
        codes[middle] = got + len(distinct)
        pairs = np.asarray(pairs)
        both = np.stack([lows[pairs // len(highs)], highs[pairs % len(highs)]], axis=1).astype("<u8")
        distinct += [x.rstrip(b"\x00") for x in both.view("S16").ravel().tolist()]
    rest = np.flatnonzero(~(short | middle))
    if len(rest):
        seen: dict[bytes, int] = {}
        base = len(distinct)
        for k, a, n in zip(rest.tolist(), starts[rest].tolist(), lengths[rest].tolist()):
            codes[k] = base + seen.setdefault(buffer[a : a + n], len(seen))
        distinct += list(seen)
    return distinct, codes


def split(texts: list[str]) -> Pieces:
    """Pre-tokens of each text; an empty text has none."""
    joined = SEPARATOR.join(texts) + SEPARATOR
    buffer = joined.encode("utf-8") + bytes(16)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + 1) - 1
    if joined.isascii():
        points = np.frombuffer(buffer, dtype=np.uint8, count=len(joined))
        symbols = character_classes()[:128][points]
        offsets = None
    else:
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        symbols = character_classes()[points]
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.cumsum(width, dtype=np.int64) - width
    symbols[ends] = END
    marks = np.zeros(len(symbols), dtype=bool)
    marks[boundaries(symbols)] = True
    marks[ends] = True
    starts = np.flatnonzero(marks)
    real = np.ones(len(starts), dtype=bool)
    closing = np.searchsorted(starts, ends)
    real[closing] = False
    at = starts if offsets is None else offsets[starts]
    lengths = np.append(np.diff(at), 0)
    plain = buffer.count(b"\x00") == len(texts) + 16
    distinct, codes = _factorized(buffer, at[real], lengths[real], plain)
    # The k-th separator has k separators before it.
    first = np.concatenate([[0], closing - np.arange(len(texts))])
    return Pieces(distinct, codes, first)
