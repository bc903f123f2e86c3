"""Connected components of large graphs by alternating star operations.

Every round makes each node's larger neighbours (large star), then its smaller ones (small star),
point at its smallest. Rounds grow with the logarithm of the graph, not with its diameter, and a round
is two minimum aggregates, which combine before they shuffle, and two joins of edges to one row per
node, whose hot nodes the adaptive planner splits. Each round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.llm.shared import written


def _towards_least(edges: DataFrame) -> DataFrame:
    """Distinct edges as (a, b) with a > b."""
    return edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node of ``edges`` (``a, b``): the least node it is connected to.

    Null ends, loops and repeated edges are ignored; a node without other edges is not returned.
    """
    now = written(_towards_least(edges), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(_towards_least(large), "edges")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(root, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(_towards_least(moved.union(root.select("a", F.col("m").alias("b")))), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
