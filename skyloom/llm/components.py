"""Connected components by alternating large and small stars, as DataFrame rounds.

Each round rewires every edge towards the smallest node known at its ends, so that
the number of rounds grows with the logarithm of a component's size. Rounds are
written to the shared folder; edges are never collected, and the smallest neighbour
of a node, however many edges it has, comes from partial minima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialise


def _with_smallest(edges: DataFrame) -> DataFrame:
    """``a, b, m``: m is the smallest of a and its neighbours b."""
    low = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return edges.join(low, "a")


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node is either a root or at the end of one edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)).isEmpty()


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b`` longs); root is the
    smallest node of the component. Self-loops and repeated edges do no harm. After as many ``rounds`` as are given, what isn't
    settled is left as it is: a node may then have another root than others of its component, or several."""
    now, done = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), 0
    while done != rounds and not _is_settled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_smallest(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now, done = materialise(small.where("a <> b").distinct()), done + 1
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
