"""Where alias lists lead to, followed from the addresses that were asked for.

Lists with one list among their members form chains. A chain is followed by jump pointers: table ``k``
holds for each such list the list ``2**k`` steps on, so a chain of any length takes as many rounds as its
length has binary digits. Only at lists with several lists as members does the search branch. Pairs (origin,
reached) exist for asked origins alone; of other lists there is a pointer at most.

Which lists are on a cycle is a question about the graph of branching lists, with chains as edges: lists
that cannot be on a cycle are peeled off, and the rest falls into strongly connected components by forward and
backward reach. Every round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.functions.scalars import to_list
from mailfleet.plans.jumps import along, jump_tables
from mailfleet.plans.session import checkpointed

# Steps of a search between two writes.
STEPS_PER_ROUND = 2


def list_members(alias: DataFrame) -> DataFrame:
    """``src, dst, inner``: members of active lists, once each; ``inner`` tells those that are lists."""
    members = alias.where("active = 1").select(
        F.lower("address").alias("src"), F.explode(to_list(F.lower("goto"))).alias("dst")).distinct()
    lists = members.select(F.col("src").alias("__l")).distinct()
    return members.join(lists, F.col("dst") == F.col("__l"), "left").select(
        "src", "dst", F.col("__l").isNotNull().alias("inner"))


def _reached(begin: DataFrame, jumps: list[DataFrame], branches: DataFrame) -> DataFrame:
    """``origin, at, depth``: every list that is reached, at its least depth. One round for each branching list on a way."""
    best, frontier = None, begin
    while True:
        step = along(frontier, jumps)
        if best is None:
            best = checkpointed(step.withColumn("before", F.lit(None).cast("bigint")), "reached")
        else:
            known = best.select("origin", "at", "depth", F.col("depth").alias("before"))
            best = checkpointed(known.unionByName(step, True).groupBy("origin", "at").agg(
                F.min("depth").alias("depth"), F.min("before").alias("before")), "reached")
        new = best.where("before is null or depth < before")
        if new.isEmpty():
            return best.drop("before")
        frontier = new.join(branches, F.col("at") == F.col("src")).groupBy("origin", F.col("dst").alias("at")).agg(
            F.min(F.col("depth") + 1).alias("depth"))


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges (a, b) between nodes that have both a way in and a way out."""
    now, n = edges, edges.count()
    while n:
        into, out = now.select(F.col("b").alias("__k")).distinct(), now.select(F.col("a").alias("__k")).distinct()
        less = checkpointed(now.join(into, F.col("a") == F.col("__k"), "left_semi").join(
            out, F.col("b") == F.col("__k"), "left_semi"), "peeled")
        m = less.count()
        if m == n:
            return less
        now, n = less, m
    return now


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the nodes of a directed graph (``a, b``) that lie on a cycle of two or more.

    Every node takes the greatest name that reaches it and the greatest that it reaches. Where both are the same, the node
    leads to that node and back: that is its component. Nodes of one component agree in both, so edges
    between others are cut, and what is left is peeled and tried again.
    """
    spark = edges.sparkSession
    left = _peeled(checkpointed(edges.where("a <> b").distinct(), "edges"))
    found = spark.createDataFrame([], "node string, component string")
    while not left.isEmpty():
        names = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().select(
            "node", F.col("node").alias("down"), F.col("node").alias("up"))
        while True:
            begin = names.select("*", F.col("down").alias("down0"), F.col("up").alias("up0"))
            for _ in range(STEPS_PER_ROUND):
                begin = _told(left, begin)
            after = checkpointed(begin.withColumn("moved", (F.col("down") > F.col("down0")) | (F.col("up") > F.col("up0"))), "names")
            names = after.select("node", "down", "up")
            if after.where("moved").isEmpty():
                break
        found = found.union(names.where("down = up").select("node", F.col("down").alias("component")))
        own = names.where("down <> up").select(F.col("node").alias("a"), F.col("down").alias("__d"), F.col("up").alias("__u"))
        left = _peeled(checkpointed(left.join(own, "a").join(own.withColumnRenamed("a", "b"), ["b", "__d", "__u"]).select("a", "b"), "edges"))
    return found


def _told(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Names after each node has told its followers what reaches it, and those before it what it reaches."""
    told = [
        edges.join(names.select(F.col("node").alias("a"), "down"), "a").select(F.col("b").alias("node"), "down"),
        edges.join(names.select(F.col("node").alias("b"), "up"), "b").select(F.col("a").alias("node"), "up"),
    ]
    return names.unionByName(told[0], True).unionByName(told[1], True).groupBy("node").agg(
        *[F.max(c).alias(c) for c in ("down", "up", "down0", "up0")])


def _on_cycles(lists: DataFrame, jumps: list[DataFrame], branches: DataFrame) -> DataFrame:
    """The lists (``at``) among ``lists`` that lead back to themselves; all that they lead to are among ``lists``."""
    edges = branches.join(lists, F.col("src") == F.col("at"), "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("t"))
    none = edges.select(F.col("a").alias("at")).where("false")
    rings = none
    if jumps:
        ends = jumps[-1].select(F.col("node").alias("__n"), F.col("to").alias("__end"))
        inside = jumps[0].select(F.col("node").alias("__end"))
        # A last jump that ends at a list with one way on has gone round.
        rings = ends.join(lists, F.col("__n") == F.col("at"), "left_semi").join(inside, "__end", "left_semi").select(
            F.col("__end").alias("at")).distinct()
        edges = edges.join(ends, F.col("t") == F.col("__n"), "left").select("a", "t", F.coalesce("__end", "t").alias("b"))
    else:
        edges = edges.withColumn("b", F.col("t"))
    branching = branches.select(F.col("src").alias("b")).distinct()
    edges = checkpointed(edges.join(branching, "b", "left_semi"), "branch-edges")
    parts = strong_components(edges.select("a", "b"))
    first, second = parts.toDF("a", "__a"), parts.toDF("b", "__b")
    closed = edges.join(first, "a", "left").join(second, "b", "left").where("a = b or __a = __b")
    between = along(
        closed.select(F.lit("").alias("origin"), F.col("t").alias("at"), F.lit(0).cast("bigint").alias("depth")), jumps)
    return rings.union(closed.select("a")).union(between.select("at")).distinct()


def expand_aliases(addresses: DataFrame, alias: DataFrame) -> DataFrame:
    """Final targets of each address of ``addresses`` (column ``address``): where lists lead to.

    ``origin, target, kind, depth``: a target is a ``leaf`` (an address without an alias) or on a ``cycle`` (it leads
    back to itself); ``depth`` is its least distance. There is no limit to the length of a way. Null addresses lead nowhere.
    """
    members = checkpointed(list_members(alias), "members")
    inner, leaves = members.where("inner").drop("inner"), members.where("not inner").drop("inner")
    ways = inner.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst"))
    jumps = jump_tables(ways.where("n = 1"))
    branches = inner.join(ways.where("n > 1").select("src"), "src", "left_semi")
    starts = addresses.select(F.lower("address").alias("origin")).where("origin is not null").distinct()
    begin = starts.join(inner, F.col("origin") == F.col("src")).select(
        "origin", F.col("dst").alias("at"), F.lit(1).cast("bigint").alias("depth"))
    reached = _reached(begin, jumps, branches)
    cycles = _on_cycles(reached.select("at").distinct(), jumps, branches)
    holders = reached.unionByName(starts.select("origin", F.col("origin").alias("at"), F.lit(0).cast("bigint").alias("depth")))
    ends = holders.join(leaves, F.col("at") == F.col("src")).groupBy("origin", F.col("dst").alias("target")).agg(
        F.min(F.col("depth") + 1).alias("depth"))
    no_list = starts.join(members.select("src").distinct(), F.col("origin") == F.col("src"), "left_anti")
    parts = [
        ends.select("origin", "target", F.lit("leaf").alias("kind"), "depth"),
        no_list.select("origin", F.col("origin").alias("target"), F.lit("leaf").alias("kind"), F.lit(0).cast("bigint").alias("depth")),
        reached.join(cycles, "at", "left_semi").select("origin", F.col("at").alias("target"), F.lit("cycle").alias("kind"), "depth"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("depth", F.col("depth").cast("int"))
