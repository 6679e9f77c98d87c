"""The vocabulary file of a byte-level BPE tokenizer."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import lru_cache


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte, as byte-level vocabularies write them.

    Printable Latin-1 characters stand for themselves; the others follow from
    U+0100 on, in the order of the bytes.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


@dataclass
class Vocabulary:
    tokens: list[bytes]  # by id
    merges: dict[int, int]  # left id << 20 | right id: rank << 20 | merged id
    byte_ids: list[int]
    special: dict[str, int] = field(default_factory=dict)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Reads a tokenizers file; raises for anything but plain byte-level BPE."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    odd = [
        spec["normalizer"],
        before.get("add_prefix_space"),
        before.get("type") != "ByteLevel",
        not before.get("use_regex", True),
        model.get("type", "BPE") != "BPE",
        model.get("ignore_merges"),
        model.get("dropout"),
        model.get("continuing_subword_prefix"),
        model.get("end_of_word_suffix"),
        len(model["vocab"]) >= 1 << 20,
        any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]),
    ]
    if any(odd):
        raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
    alphabet = byte_alphabet()
    ids = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for token, i in ids.items():
        tokens[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    for token, i in special.items():
        tokens[i] = token.encode()
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[ids[left] << 20 | ids[right]] = rank << 20 | ids[left + right]
    of_byte = {b: ids[c] for c, b in alphabet.items()}
    return Vocabulary(tokens, merges, [of_byte[b] for b in range(256)], special)
