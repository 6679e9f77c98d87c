"""Token counts, BPE and packing against the tokenizer library."""

from __future__ import annotations

import random
import struct
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from llm.helpers import documents, table
from sqltide.llm import bpe, lockstep, packing, pretokens, token_counts
from sqltide.llm.vocabulary import load

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [
    "a", "'", "s", "t", "re", "ve", "ll", "'ll", "r", "l", "e", " ", "  ", "\n", "\t", "1", "23", "!", "?", "é", "ß",
    "中", "😀", " ", "\x00", "　", "<|endoftext|>", "<|endof", "d", "m", "'v", "A", "՘", "٣", "²",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(7)
    mixed = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    words = ["".join(draw.choice("etaoinshr ") for _ in range(draw.randint(0, 300))) for _ in range(300)]
    runs = [c * n for c in "a =-\n" for n in (1, 2, 3, 63, 64, 65, 127, 128, 129, 1000)]
    return [*mixed, *words, *runs, "", "x" * 20_000, "one two " * 5000]


def ids_of(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_classes_agree_with_the_library():
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for block in range(0, 0x32000, 0x1000):
        characters = [chr(c) for c in range(block, block + 0x1000) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}! {c}" for c in characters)
        expected = [text[a:b].encode() for _, (a, b) in split(text)] if text else []
        pieces = pretokens.split([text])
        assert [pieces.distinct[c] for c in pieces.codes] == expected


@pytest.mark.parametrize("kind", [bpe.Encoder, lockstep.LockstepEncoder])
def test_ids_equal_the_library(kind, library, texts):
    ids, offsets = kind(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == ids_of(library, texts)


def test_small_memory_gives_the_same(library, texts):
    tool = bpe.Encoder(PATH)
    tool.memory = 10
    ids, offsets = tool.encode(texts[:200])
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == ids_of(library, texts[:200])


def test_counts_equal_the_library(library, texts, monkeypatch):
    expected = [len(x) for x in ids_of(library, texts)]
    assert token_counts.Counter(PATH).counts(texts).tolist() == expected
    monkeypatch.setattr(token_counts, "STATES", 50)
    monkeypatch.setattr(token_counts, "MEMO", 10)
    assert token_counts.Counter(PATH).counts(texts[:300]).tolist() == expected[:300]


def test_chunk_maps_compose_to_the_sequential_run():
    draw = np.random.default_rng(3)
    symbols = np.append(draw.integers(0, pretokens.SYMBOLS, 5000), pretokens.END).astype(np.uint8)
    state, here = pretokens.FRESH, set()
    for i, s in enumerate(symbols):
        at = int(s) * pretokens.STATES + state
        emitted, state = pretokens.EMIT[at], int(pretokens.NEXT[at])
        if emitted & pretokens.HERE:
            here.add(i)
        if emitted & pretokens.BEFORE:
            here.add(i - 1)
    assert sorted(here) == pretokens.boundaries(symbols).tolist()


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(ValueError):
        load(public_tokenizers.path("word_bpe_49k.json"))


def test_op1_rows(spark, library):
    texts = [None, "", "Hello  world", "<|endoftext|> it's", "é" * 3000, (3, "Hello  world"), (None, "a b")]
    df = documents(spark, texts).withColumnRenamed("lang", "n_tokens")
    rows = sorted(token_counts.counted_documents(df, PATH).collect(), key=str)
    plain = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    n = {t: len(library.encode(t or "", add_special_tokens=False).ids) for _, t in plain}
    expected = [(i, len((t or "").encode()), n[t], n[t] > 512) for i, t in plain]
    assert [tuple(r) for r in rows] == [tuple(r) for r in sorted(expected, key=lambda r: str(spark.createDataFrame([r], rows_schema()).first()))]
    assert token_counts.counted_documents(df.limit(0), PATH).collect() == []
    assert token_counts.token_counts(df, PATH).columns == ["doc_id", "text", "source", "n_chars", "n_tokens"]


def rows_schema():
    return "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def test_op2_rows(spark, library):
    texts = [None, "", "It's <|endoftext|> é😀\x00", "a" * 5000, "same", "same"]
    df = documents(spark, texts).withColumnRenamed("lang", "ids")
    got = table(bpe.bpe_round_trip(df, PATH))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == sha256(back.encode()).hexdigest()
    assert bpe.bpe_round_trip(df.limit(0), PATH).collect() == []


def test_decoding_broken_bytes(spark, library):
    df = spark.createDataFrame([(1, [163]), (2, None), (3, [50256, 64]), (4, [])], "doc_id long, ids array<int>")
    got = table(bpe.decode(df, PATH))
    assert [got[i].decoded for i in (1, 3)] == [library.decode([163], False), library.decode([50256, 64], False)]
    assert got[2].decoded == got[4].decoded == ""


def check_packing(rows, ids_by_id, length):
    """Every id in one piece, gapless sequences, full but for the last one."""
    pieces, sequences = {}, {}
    for r in rows:
        ids = list(struct.unpack(f"<{r.length}I", r.ids))
        assert r.length > 0 and zlib.crc32(r.ids) >= 0
        pieces.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
    for doc, expected in ids_by_id.items():
        found = sorted(pieces[doc])
        assert [s for s, _, _ in found] == list(np.cumsum([0, *(len(i) for _, i, _ in found)])[:-1])
        assert [x for _, i, _ in found for x in i] == expected
        assert {n for _, _, n in found} == {len(expected)}
    assert sorted(sequences) == list(range(len(sequences)))
    for s, parts in sequences.items():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at == length or s == len(sequences) - 1
        assert {p for _, _, p in parts} == {at if at & (at - 1) == 0 else length}


@pytest.mark.parametrize("length", [8, 64, 2048])
@pytest.mark.parametrize("partitions", [1, 5])
def test_packing_covers_every_id_once(spark, library, length, partitions):
    texts = [None, "", "one two three", "word " * 3000, "x", "y" * 500, "<|endoftext|>"]
    df = documents(spark, texts).repartition(partitions).withColumnRenamed("lang", "part")
    rows = packing.packed(df, PATH, length).collect()
    check_packing(rows, {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}, length)


def test_packing_of_repeated_and_no_rows(spark):
    df = documents(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    rows = packing.packed(df, PATH).collect()
    assert sorted((r.doc_id is None, r.length, r.offset) for r in rows) == [(False, 3, 0), (False, 3, 3), (True, 2, 6)]
    assert packing.packed_documents(df.limit(0), PATH).collect() == []
