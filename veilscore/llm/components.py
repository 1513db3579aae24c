"""Connected components of an edge table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import released, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` (long ids, undirected).

    Alternating large-star and small-star steps: each step links every node to
    the smallest neighbour known, until only stars are left; the root is the
    smallest id of the component.  The minimum per node is combined before the
    shuffle and written out before it is joined back, so that join has a plain
    exchange on either side and a hub with very many edges can be split by
    adaptive execution.  Nulls and loops are ignored; an empty table gives an
    empty result.
    """
    current = stored(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = _mark(current)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        last = mark
        current = _round(current)
        mark = _mark(current)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stored(both.groupBy("u").agg(F.min("v").alias("m"))
                   .select("u", F.least("u", "m").alias("m")), "cc-large")
    large = stored(both.filter("v > u").join(least, "u")
                   .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "cc-mid")
    lower = stored(large.groupBy("a").agg(F.min("b").alias("m")), "cc-small")
    linked = (large.join(lower, "a").filter("b <> m")
              .select(F.col("b").alias("a"), F.col("m").alias("b")))
    out = stored(linked.union(lower.select("a", F.col("m").alias("b"))).distinct(), "cc")
    released(edges, least, large, lower)
    return out
