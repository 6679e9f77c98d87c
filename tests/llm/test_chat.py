"""Chat formatting."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest

from llm.helpers import table
from sqltide.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", " ", "a", "[", "]", "<", "\\\\"]


def test_escaping_is_reversible():
    draw = random.Random(5)
    for _ in range(5000):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(escaped.startswith(c) for c in chat.CONTROL)
    assert chat.escape("a [b] <i> \\n") == "a [b] <i> \\n"


def test_spans_and_reading_back():
    template = chat.InstructTemplate()
    turns = [("system", ""), ("user", "</s>\\"), ("assistant", "[INST] x\n</s>\n<s>user"), ("tool\n%", "t")]
    text, ends = chat.turn_spans(turns, template)
    begin, back = 0, []
    for end in ends:
        role, a, b = template.parse(text[begin:end])
        back.append((role, chat.unescape(text[begin + a : begin + b])))
        begin = end
    assert back == turns and ends[-1] == len(text)


def test_templates_that_rewrite_history_are_found():
    def only_last_thought(turns):
        last = len(turns) - 1
        return "".join(f"{r}:{t if i == last else t.replace('(hm)', '')};" for i, (r, t) in enumerate(turns))

    assert chat.turn_spans([("a", "x"), ("b", "y")], only_last_thought)[1] == [4, 8]
    assert chat.turn_spans([("a", "(hm)x"), ("b", "y")], only_last_thought)[1] is None


def test_op8_rows(spark):
    rows = [
        (1, 1, "assistant", "second"), (1, 0, "user", "first"), (2, 0, None, None), (2, 0, None, None),
        (3, None, "assistant", ""), (3, 5, "assistant", "é😀"), (None, 0, "user", "lost"), (4, 0, "user", "x" * 9000),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = table(chat.formatted_conversations(df), "conv_id")
    digest = lambda text: sha256(text.encode()).hexdigest()
    assert set(got) == {-1, None, 1, 2, 3, 4}
    assert got[1].turns_sha256 == digest("user\nfirst\nassistant\nsecond\n") and got[1].loss_sha256 == digest("second")
    assert got[2].n_turns == 2 and got[2].turns_sha256 == digest("\n\n\n\n") and got[2].loss_chars == 0
    assert got[3].loss_chars == 2 and got[3].loss_sha256 == digest("é😀")
    assert got[-1].loss_sha256 == digest(chat.ADDED_TEXT) and got[-1].loss_chars == len(chat.ADDED_TEXT)
    assert set(table(chat.formatted_conversations(df.limit(0)), "conv_id")) == {-1}


def test_rewritten_conversations_have_no_spans(spark):
    def rewriting(turns):
        return f"{len(turns)} turns" if len(turns) > 1 else "".join(t for _, t in turns)

    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "c")], SCHEMA)
    got = table(chat.formatted(df, rewriting), "conv_id")
    assert got[1].rewrites and got[1].turn_ends is None and got[1].formatted == "2 turns"
    assert not got[2].rewrites and got[2].turn_ends == [1]


@pytest.mark.parametrize("extra", ["formatted", "n_turns"])
def test_clashing_columns(spark, extra):
    df = spark.createDataFrame([(1, 0, "user", "a", 5)], f"{SCHEMA}, {extra} long")
    assert table(chat.formatted(df), "conv_id")[1].n_turns == 1


def test_a_table_with_the_added_id(spark):
    """The added conversation and one of its id stay two."""
    df = spark.createDataFrame([(-1, 0, "user", "mine"), (5, 0, "assistant", "y" * 2_000_000)], SCHEMA)
    rows = chat.formatted_conversations(df).collect()
    assert sorted((r.conv_id, r.n_turns, r.loss_chars) for r in rows) == [
        (-1, 1, 0), (-1, 2, len(chat.ADDED_TEXT)), (5, 1, 2_000_000)
    ]
