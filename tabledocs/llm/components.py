"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond"). Each step is a group minimum (partial before the shuffle) and a join
on the node; a step's edges are written to the shared folder, so no lineage
grows and nothing but two numbers a step reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabledocs.llm.common import written


def _star(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each (u, v) of ``pairs`` to (v, the least neighbour of u in ``edges``)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _star(both, both.where("v > u")).distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _star(down, down).union(down.groupBy("u").agg(F.min("v").alias("v")))
    return small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v): any undirected links. Returns (u, v) for every node u
    that is not the least node v of its component."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = mark(now)
    while seen[0]:
        now = written(_step(now), "edges")
        if (new := mark(now)) == seen:
            break
        seen = new
    return now
