"""Chat formatting by black-box rendering of turn prefixes.

A template is any function from a list of (role, text) turns to a string.  It
is rendered on one turn, two turns and so on; what an output adds to the one
before is the span of that turn.  If an output does not begin with the one
before, the template has rewritten history and the conversation has no spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The control strings of the instruction template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile(r"\\*(?:" + "|".join(map(re.escape, CONTROL)) + ")")
_ESCAPED = re.compile(r"\\(\\*(?:" + "|".join(map(re.escape, CONTROL)) + "))")


def escape(text: str) -> str:
    """A backslash before every control string, so that none stands alone; ``unescape`` undoes it."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class InstructTemplate:
    """``<s>role``, a line break, the text (in ``[INST]`` marks for a user), a line break, ``</s>``.

    The text stands between line breaks or spaces, so its end cannot escape a
    mark.  Roles are percent-encoded.  ``parse`` reads a turn's span back.
    """

    user: str = "user"

    def __call__(self, turns: Iterable[Turn]) -> str:
        out = []
        for role, text in turns:
            body = f"[INST] {escape(text)} [/INST]" if role == self.user else escape(text)
            out.append(f"<s>{quote(role, safe=' ')}\n{body}\n</s>\n")
        return "".join(out)

    def parse(self, span: str) -> tuple[str, int, int]:
        """Role of a turn's span, and where its escaped text starts and ends."""
        line = span.index("\n")
        role = unquote(span[len("<s>") : line])
        start, end = line + 1, len(span) - len("\n</s>\n")
        if role == self.user:
            start, end = start + len("[INST] "), end - len(" [/INST]")
        return role, start, end


def turn_spans(turns: list[Turn], template: Template) -> tuple[str, list[int] | None]:
    """The rendered conversation and where each turn's span ends; None if history is rewritten."""
    before, ends = template([]), []
    for n in range(1, len(turns) + 1):
        after = template(turns[:n])
        if not after.startswith(before):
            return template(turns), None
        ends.append(len(after))
        before = after
    return before, ends


FORMATTED = "conv_id {kind}, n_turns long, formatted string, turn_ends array<long>, rewrites boolean"


def conversations_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Runs of equal conversation ids in sorted rows, across batches."""
    current, turns = None, None
    for batch in rows:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        for conv, role, text in zip(*columns):
            if turns is None or conv != current:
                if turns is not None:
                    yield current, turns
                current, turns = conv, []
            turns.append((role or "", text or ""))
    if turns is not None:
        yield current, turns


def formatted(df: DataFrame, template: Template = InstructTemplate()) -> DataFrame:
    """One row per conversation: the formatted text and the end of each turn's span in code points.

    Turns stand in the order of ``turn``, then role and text for ties; nulls
    first.  Null roles and texts are empty; rows with a null ``conv_id`` form
    one conversation.  Repeated rows are turns of their own.  Other columns
    are not returned.  ``rewrites`` tells that the template changed earlier
    output, and then ``turn_ends`` is null.  Rows are sorted and streamed, so a
    task holds one conversation at a time; a conversation must fit one row.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    rows = (
        df.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    schema = pa.schema(
        [
            ("n_turns", pa.int64()), ("formatted", pa.string()),
            ("turn_ends", pa.list_(pa.int64())), ("rewrites", pa.bool_()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        own = pa.schema([pa.field("conv_id", first.schema.field(0).type), *schema])

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        out, size = [], 0
        for conv, turns in conversations_of(all_batches()):
            text, ends = turn_spans(turns, template)
            out.append((conv, len(turns), text, ends, ends is None))
            size += len(text)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), own)], schema=own)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), own)], schema=own)

    return rows.mapInArrow(run, FORMATTED.format(kind=kind))


def loss_masked(df: DataFrame, template: InstructTemplate = InstructTemplate(), learn: str = "assistant") -> DataFrame:
    """Adds ``turns``: role, span of the escaped text in ``formatted``, and whether it is learned.

    Read back from the formatted text and its spans; only texts of ``learn``
    are under the loss mask.  Conversations without spans have null.
    """
    kind = df.schema.simpleString()[len("struct<") : -1]
    place = {c: i for i, c in enumerate(df.columns)}
    fields = [("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("learn", pa.bool_())]
    turns_type = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ends in zip(
                batch.column(place["formatted"]).to_pylist(), batch.column(place["turn_ends"]).to_pylist()
            ):
                turns, begin = [], 0
                for end in ends or []:
                    role, a, b = template.parse(text[begin:end])
                    turns.append({"role": role, "start": begin + a, "end": begin + b, "learn": role == learn})
                    begin = end
                out.append(None if ends is None else turns)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, turns_type)], [*batch.schema.names, "turns"]
            )

    return df.mapInArrow(run, f"{kind},turns:array<struct<role:string,start:bigint,end:bigint,learn:boolean>>")


def digests(df: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say, from their text and spans alone."""
    kind = df.schema["conv_id"].dataType.simpleString()
    place = {c: i for i, c in enumerate(df.columns)}
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, text, turns, rewrites = (
                batch.column(place[c]) for c in ("conv_id", "formatted", "turns", "rewrites")
            )
            rows = []
            for whole, spans in zip(text.to_pylist(), turns.to_pylist()):
                every, learned, n = sha256(), sha256(), 0
                for s in spans or []:
                    said = unescape(whole[s["start"] : s["end"]])
                    every.update(f"{s['role']}\n{said}\n".encode())
                    if s["learn"]:
                        learned.update(said.encode())
                        n += len(said)
                rows.append((len(spans or []), every.hexdigest(), n, learned.hexdigest(), len(whole)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([conv, *arrays, rewrites], names)

    return df.mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long, rewrites boolean",
    )


# The conversation that the query adds.
ADDED_ID, ADDED_TEXT = -1, "</s>[INST] ok [/INST]"


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back.

    The added conversation is one of its own, also where the table has one of its id.
    """
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    return digests(loss_masked(formatted(rows).union(formatted(added))))


SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS added FROM conversations
  UNION ALL VALUES ({ADDED_ID}, 0, 'user', '{ADDED_TEXT}', true), ({ADDED_ID}, 1, 'assistant', '{ADDED_TEXT}', true)),
escaped AS (
  SELECT *, length(regexp_replace(text, '(<s>|</s>|\\[INST\\]|\\[/INST\\])', '\\\\\\1', 'g')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(3 + length(role) + 1 + n + 6 + CASE role WHEN 'user' THEN 15 ELSE 0 END) AS bigint) AS formatted_chars,
  false AS rewrites
FROM escaped GROUP BY conv_id, added"""
