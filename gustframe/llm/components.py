"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (pairs.where("v > u").join(least, "u").where("v <> m")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have a < b: b hangs its smaller neighbours and itself under the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    hung = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return hung.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that can be reached.

    Rounds end when the edge table no longer changes; each round's table is written to the shared
    folder. An empty edge table gives an empty result.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                   "edges")
    state = _state(edges)
    while state[0]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    hung = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return hung.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
