"""Packing documents into token sequences of fixed length: concatenate and cut.

All documents form one stream of tokens in the order of partitions and rows.
The first pass encodes and writes the ids with the tokens before each document
in its partition; prefix sums over the partitions' totals, one row per
partition, give every document its place in the stream.  The second pass cuts
the stream at the multiples of the length.  Only the last sequence has padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqltide.llm.bpe import text_slices
from sqltide.llm.lockstep import lockstep_encoder
from sqltide.llm.shared import stored

LENGTH, END = 2048, 1


def encoded_stream(df: DataFrame, path: str, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of each document and ``end`` as little-endian 32-bit numbers, and its place in its partition."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, before = lockstep_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                values, offsets = tool.encode(texts)
                values = np.insert(values, offsets[1:], end).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                ids = pa.Array.from_buffers(
                    pa.binary(), len(texts),
                    [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(values)],
                )
                n = np.diff(offsets)
                columns = [
                    batch.column(0).slice(start, len(texts)),
                    pa.array(np.full(len(texts), part, dtype=np.int32)),
                    pa.array(before + offsets[:-1]),
                    pa.array(n),
                    ids,
                ]
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(columns, ["key", "part", "before", "doc_tokens", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, part int, before long, doc_tokens long, ids binary"
    )


def packed(
    df: DataFrame, path: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of a document in a sequence.

    ``start`` and ``length`` place the piece in its document, ``sequence_id``
    and ``offset`` in the packed sequences; ``ids`` are its tokens as
    little-endian unsigned 32-bit numbers.  ``padded_length`` is the length of
    the padded sequence: ``length``, or the tokens in it if a power of two.
    Null and empty texts are one token, ``end``.  Repeated rows are documents
    of their own; other columns are not returned.  An empty table has no rows.
    """
    stream = stored(encoded_stream(df, path, end, key, text), "packing")
    totals = stream.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("tokens"))
    # One row per partition of the input.
    order = Window.orderBy("part")
    places = totals.select(
        "part",
        (F.sum("tokens").over(order) - F.col("tokens")).alias("base"),
        F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    # One row per task of the first pass: small enough to send everywhere.
    placed = stream.join(F.broadcast(places), "part").withColumn("at", F.col("base") + F.col("before"))
    cut = F.expr(
        f"""transform(sequence(at div {length}, (at + doc_tokens - 1) div {length}), s -> named_struct(
            'sequence_id', s,
            'start', greatest(s * {length} - at, 0L),
            'ids', substring(ids, cast(greatest(s * {length} - at, 0L) * 4 + 1 as int), cast(4 *
                (least((s + 1) * {length} - at, doc_tokens) - greatest(s * {length} - at, 0L)) as int))))"""
    )
    pieces = placed.select("key", "doc_tokens", "at", "total", F.inline(cut))
    fill = F.least(F.lit(length).cast("long"), F.col("total") - F.col("sequence_id") * length)
    return pieces.select(
        F.col("key").alias(key),
        "start",
        F.expr("octet_length(ids) div 4").alias("length"),
        "ids",
        "doc_tokens",
        "sequence_id",
        (F.col("at") + F.col("start") - F.col("sequence_id") * length).alias("offset"),
        F.when(fill.bitwiseAND(fill - 1) == 0, fill).otherwise(length).cast("long").alias("padded_length"),
    )


def packed_documents(documents: DataFrame, path: str) -> DataFrame:
    """The pieces of all documents, with a checksum in place of the ids."""
    return packed(documents, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "padded_length",
    )
