"""Pointer doubling: long ways through a graph in as many rounds as their length has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.plans.session import checkpointed


def jump_tables(single: DataFrame) -> list[DataFrame]:
    """Tables of ``node, to, steps``: from each node with one way on (``src, dst``), 1, 2, 4, … steps on.

    A jump ends at a node without a single way on, with the steps it took. The last table therefore tells the end of each
    chain; where that end has a way on itself, the chain runs into a ring of such nodes, and is on it.
    """
    now = checkpointed(single.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(1).cast("bigint").alias("steps")), "jumps")
    moving, tables = now.count(), []
    if not moving:
        return tables
    while True:
        tables.append(now)
        # What leads into a ring moves for ever, and so does the ring: neither is longer than these are many.
        if 1 << len(tables) > 2 * moving:
            return tables
        on = now.select(F.col("node").alias("__n"), F.col("to").alias("__to"), F.col("steps").alias("__s"))
        further = checkpointed(now.join(on, F.col("to") == F.col("__n"), "left").select(
            "node", F.coalesce("__to", "to").alias("to"), (F.col("steps") + F.coalesce("__s", F.lit(0))).alias("steps"),
            F.col("__n").isNotNull().alias("moved")), "jumps")
        moving = further.where("moved").count()
        if not moving:
            return tables
        now = further.drop("moved")


def along(rows: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``origin, at, depth`` with all nodes on the chains that begin at ``at``, each at its least depth."""
    for table in jumps:
        jump = table.select(F.col("node").alias("__n"), F.col("to").alias("__to"), F.col("steps").alias("__s"))
        stay, go = F.struct("at", "depth"), F.struct(F.col("__to").alias("at"), (F.col("depth") + F.col("__s")).alias("depth"))
        both = F.when(F.col("__n").isNull(), F.array(stay)).otherwise(F.array(stay, go))
        rows = rows.join(jump, F.col("at") == F.col("__n"), "left").select("origin", F.explode(both).alias("p")).select(
            "origin", "p.at", "p.depth").groupBy("origin", "at").agg(F.min("depth").alias("depth"))
    return rows
