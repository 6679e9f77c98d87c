"""Connected components of a table of links, on Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in ``links`` (``a``, ``b``).

    Alternates large-star and small-star steps, which hang every node on the
    least neighbour, until every node hangs on one that hangs on none; each round is one aggregation and
    one join on the links, without collecting a node's neighbours.  Rounds
    grow with the logarithm of the longest path.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    while not _are_stars(edges):
        both = edges.select(F.inline(_both_ways("u", "v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: the larger neighbours of u hang on the least of u and its neighbours.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u and its smaller neighbours hang on the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        hung = small.select(F.inline(F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "vu"])))
        edges = stored(hung.where("u <> v").distinct(), "links")
    # Stars now: every edge leads to the least id of its component.
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _both_ways(a: str, b: str) -> Column:
    return F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ((a, b), (b, a))])


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and none on a node that hangs itself."""
    roles = edges.select(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        edges.select(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    counted = roles.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return counted.where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()
