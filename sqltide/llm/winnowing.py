"""Document fingerprints by winnowing, in DataFrame functions only.

The units are words, in lower case.  In a run of more than sixteen characters
without white space every character is a unit, so that texts without spaces
share hashes wherever a common passage begins in them.  The hash of k units is
the polynomial that a rolling hash gives; all of them come from log2(k)
doubling steps (the hash of 2m words from two of m words), and window minima
likewise, so the work is linear in the text.  A text is worked through in
overlapping pieces, so a long one needs no more memory than its own size and
that of its fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqltide.llm.shared import stored

K, WINDOW = 4, 8
PRIME = 2147483647
BASE = 1_000_003
WORD = r"\S{1,16}"  # a longer run is cut every sixteen characters from its start
UNIT = r"(?<!\S)\S{1,16}(?!\S)|\S"  # a longer run is cut into characters
HIGH = 1 << 32
PIECE = 4096  # units of a text that are worked through at a time


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubled(values: Column, by: int, combined: Callable[[Column, Column], Column]) -> Column:
    """Element i joined with element i + ``by``, for every i that has one."""
    return _let(
        values,
        lambda v: F.transform(
            F.slice(v, 1, F.greatest(F.size(v) - by, F.lit(0))), lambda x, i: combined(x, F.get(v, i + by))
        ),
    )


def _filled(values: Column, least: int, value: int, where: Column) -> Column:
    """Fewer than ``least`` values, but not none, are followed by ``value`` up to that number."""
    return _let(
        values,
        lambda v: F.when(
            where & F.size(v).between(1, least - 1),
            F.concat(v, F.array_repeat(F.lit(value).cast("long"), F.lit(least) - F.size(v))),
        ).otherwise(v),
    )


def _selected(piece: Column, number: Column, k: int, window: int, units: int) -> Column:
    """The hashes that the windows of one piece select; but for the first piece, its first window is the one before."""
    first = number == 0
    own = F.transform(F.split(F.rtrim(piece), " "), lambda u: F.pmod(F.xxhash64(u), F.lit(PRIME)))
    # Shorter texts are padded with zeros, after all units: their one hash.
    own = _filled(own, k, 0, first)
    m = 1
    while m < k:
        factor = pow(BASE, m, PRIME)
        own = _doubled(own, m, lambda x, y, factor=factor: (x * F.lit(factor) + y) % F.lit(PRIME))
        m *= 2
    start = F.lit(HIGH - 1) - number.cast("long") * units + F.when(first, 0).otherwise(1)
    ranked = _let(start, lambda at: F.transform(own, lambda x, i: x * F.lit(HIGH) + (at - i)))
    # The last elements stand for hashes beyond the end: a short text is one window.
    ranked = _filled(ranked, window, (1 << 63) - 1, first)
    m = 1
    while m < window:
        ranked = _doubled(ranked, m, F.least)
        m *= 2
    return _let(
        ranked,
        lambda v: F.when(first, F.array_distinct(v)).otherwise(
            F.filter(F.array_distinct(v), lambda x: x != F.get(v, F.lit(0)))
        ),
    )


def with_fingerprint(
    df: DataFrame, text: str, name: str, k: int = K, window: int = WINDOW, unit: str = WORD, units: int = PIECE
) -> DataFrame:
    """Adds ``name``: the selected hashes with their positions, in order of position.

    Each element is hash * 2**32 + (2**32 - 1 - position), so that the least
    of a window is its least hash, the rightmost among equals.  ``k`` and
    ``window`` are powers of two.  A text of fewer than k units has the hash
    of all its units; fewer hashes than a window are one window.  Two texts
    that share ``k + window - 1`` units in a row share a selected hash.  With
    ``UNIT`` these are whole words, or characters of runs longer than 16 in
    both texts, as any passage of 17 or more without white space is; with
    ``WORD`` a longer run must be shared at the same offset, modulo 16.
    Null and empty texts, and texts of white space, have an empty fingerprint.

    A text is worked through in pieces of ``units`` units, which overlap by
    what a window spans, so only one piece's units are held at a time beside
    the text and its fingerprint; the result does not depend on the length.
    """
    if k & (k - 1) or window & (window - 1):
        raise ValueError("k and window must be powers of two")
    if units < k + window:
        raise ValueError("a piece must hold more units than a window spans")
    # Every unit is followed by one blank.
    stream = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), rf"({unit})\s*", "$1 ")
    out = df.withColumn("_p", F.regexp_extract_all(stream, F.lit(rf"(?:\S++ ){{1,{units}}}+"), F.lit(0)))

    def with_edges(piece: Column, number: Column) -> Column:
        before = F.concat(F.substring_index(F.rtrim(F.get("_p", number - 1)), " ", -1), F.lit(" "))
        after = F.regexp_extract(F.get("_p", number + 1), rf"^(?:\S++ ){{0,{k + window - 2}}}+", 0)
        return F.concat(F.coalesce(before, F.lit("")), piece, F.coalesce(after, F.lit("")))

    selected = F.transform("_p", lambda p, j: _selected(with_edges(p, j), j, k, window, units))
    return out.withColumn(name, F.flatten(selected)).drop("_p")


def hashes(fingerprint: str) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.expr(f"transform({fingerprint}, x -> cast(x div {HIGH} as int))"))


def positions(fingerprint: str) -> Column:
    """Hash and position (of the first unit, from 0) of every selected hash."""
    return F.expr(
        f"transform({fingerprint}, x -> named_struct('hash', cast(x div {HIGH} as int),"
        f" 'position', cast({HIGH - 1} - x % {HIGH} as int)))"
    )


def as_text(fingerprint: str) -> Column:
    """``hash@position``, hash in hexadecimal, separated by blanks."""
    part = f"concat(lower(hex(x div {HIGH})), '@', {HIGH - 1} - x % {HIGH})"
    return F.expr(
        f"array_join(transform(sequence(1, greatest(size({fingerprint}), 1), {PIECE}),"
        f" s -> array_join(transform(slice({fingerprint}, s, {PIECE}), x -> {part}), ' ')), ' ')"
    )


def likeness(left: str, right: str) -> Column:
    """Shared hashes over the mean number of hashes; two empty sets are alike."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / total)


def with_next(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``next``: the ``order`` columns of the row that follows in descending order, after the last the first.

    No two rows are equal in ``order``; nulls are least.  The rows are
    range-partitioned; the neighbour of a piece's first row comes from the
    piece before, of which one row each is looked at.
    """
    pieces = stored(rows.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id()), "winnowing")
    local = pieces.withColumn("next", F.lag(F.struct(*order)).over(Window.partitionBy("_piece").orderBy(*order)))
    last = pieces.groupBy("_piece").agg(F.max(F.struct(*order)).alias("_last"))
    by_piece = Window.orderBy("_piece")
    everywhere = by_piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = last.select(
        "_piece", F.coalesce(F.lag("_last").over(by_piece), F.max("_last").over(everywhere)).alias("_carried")
    )
    return (
        local.join(carried, "_piece").withColumn("next", F.coalesce("next", "_carried")).drop("_piece", "_carried")
    )


def compared_documents(documents: DataFrame, without_id: bool = False) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness: one row for each row.

    In the edited text the last half of the characters gives way to the first
    as many of the next document.  Rows stand in descending order of id; those
    that share an id stand in the order of a 128-bit hash of id and text, so
    the next of a repeated row may have the same id, and that of equal rows
    is an equal row for all but one of them.  Rows with a null id are left
    out, or, if ``without_id``, stand after all others.
    """
    rows = documents if without_id else documents.where("doc_id IS NOT NULL")
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns(
        {"a": F.xxhash64("doc_id", "text"), "b": F.xxhash64(F.lit(1), "doc_id", "text")}
    )
    # Both joins read one shuffle of the texts, and the sort by which equal rows are counted.
    copies = Window.partitionBy("a", "b", "doc_id").orderBy("a")
    texts = rows.repartition("a", "b").withColumn("copy", F.row_number().over(copies))
    links = with_next(
        rows.select("doc_id", "a", "b", F.length("text").alias("n")).distinct(), ("doc_id", "a", "b")
    ).select("a", "b", "n", F.col("next.a").alias("next_a"), F.col("next.b").alias("next_b"))
    one_each = texts.where("copy = 1").select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), "text")
    following = links.join(one_each, ["next_a", "next_b"]).select(
        "a", "b", F.expr("substring(text, 1, n div 2)").alias("put"), "text"
    )
    following = with_fingerprint(following, "text", "fp", unit=UNIT).select("a", "b", "put", hashes("fp").alias("next_hashes"))
    both = (
        texts.join(following, ["a", "b"])
        .withColumn("put", F.expr("if(copy = 1, put, substring(text, 1, length(text) div 2))"))
        .withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), "put"))
    )
    both = with_fingerprint(both, "text", "fp", unit=UNIT)
    both = with_fingerprint(both, "edited", "efp", unit=UNIT)
    both = both.withColumns({"own": hashes("fp"), "own_edited": hashes("efp")})
    both = both.withColumn("next_hashes", F.expr("if(copy = 1, next_hashes, own)"))
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("fp").alias("fingerprint"),
        as_text("efp").alias("edited_fingerprint"),
        likeness("own", "own_edited").alias("near_edited"),
        likeness("own", "next_hashes").alias("near_next"),
    )
