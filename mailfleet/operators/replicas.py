"""Comparing and reconciling two replicas of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailfleet.functions.scalars import epoch_us, parity, row_hash
from mailfleet.plans.session import checkpointed
from mailfleet.sources.schema import NODE_LOCAL


def _payload(df: DataFrame, key: Sequence[str], ignore: Sequence[str]) -> list[str]:
    return sorted(c for c in df.columns if c not in key and c not in ignore)


def replicated_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Without the counters each node keeps for itself."""
    return {name: df for name, df in tables.items() if name not in NODE_LOCAL}


def replica_diff(
    a: DataFrame, b: DataFrame, key: Sequence[str], ignore: Sequence[str] = ()
) -> DataFrame:
    """State of every key: ``equal``, ``changed``, ``only_a`` or ``only_b``.

    Both sides shrink to key and a 64-bit content hash before the one shuffle, and are combined
    by a hash aggregate: keys are spread evenly and no row width travels. The hash passes over
    nulls, so it also covers which columns are null.
    """
    cols = _payload(a, key, ignore)
    content = F.xxhash64(*cols, *[F.col(c).isNull() for c in cols])
    sides = [
        df.select(*key, F.lit(side).alias("__s"), content.alias("__h"))
        for side, df in (("a", a), ("b", b))
    ]
    both = sides[0].unionByName(sides[1])
    rows = both.groupBy(*key).agg(
        F.max(F.when(F.col("__s") == "a", F.col("__h"))).alias("hash_a"),
        F.max(F.when(F.col("__s") == "b", F.col("__h"))).alias("hash_b"),
    )
    state = (
        F.when(F.col("hash_b").isNull(), "only_a").when(F.col("hash_a").isNull(), "only_b")
        .when(F.col("hash_a") == F.col("hash_b"), "equal").otherwise("changed")
    )
    return rows.select(*key, state.alias("state"))


# Ranges per level of a digest tree, as a power of two; also the most ranges whose numbers are sent to tasks.
TREE_BITS = 12


def range_digests(df: DataFrame, key: Sequence[str], ignore: Sequence[str] = (), bits: int = TREE_BITS) -> DataFrame:
    """``node, rows, digest`` for each of the ``2**bits`` ranges of the hashed key that holds rows.

    Count, exclusive or, and sum over content hashes combine in the reading tasks, so a range costs one row per task,
    whatever it holds; the digests of a level follow from those of a finer one as well as from rows.
    """
    return _digests(_placed(df, key, ignore), bits)


def _placed(df: DataFrame, key: Sequence[str], ignore: Sequence[str]) -> DataFrame:
    cols = _payload(df, key, ignore)
    all_cells = [*key, *cols, *[F.col(c).isNull() for c in (*key, *cols)]]
    return df.select(
        F.xxhash64(*key).alias("__at"), F.xxhash64(F.lit(1), *all_cells).alias("__h1"), F.xxhash64(F.lit(2), *all_cells).alias("__h2"))


def _digests(placed: DataFrame, bits: int) -> DataFrame:
    node = F.shiftrightunsigned("__at", 64 - bits).alias("node")
    return placed.groupBy(node).agg(
        F.count(F.lit(1)).alias("rows"),
        F.struct(F.bit_xor("__h1").alias("mix"), F.sum(F.col("__h2").cast("decimal(38,0)")).alias("sum")).alias("digest"))


def replica_changes(
    a: DataFrame, b: DataFrame, key: Sequence[str], ignore: Sequence[str] = (), bits: int = TREE_BITS, levels: int = 2,
) -> DataFrame:
    """The keys whose state is not ``equal``, as in ``replica_diff``, found down a tree of digests.

    Both sides are digested in ranges of the hashed key; ranges with equal digests are settled, and the others are digested again in
    finer ranges, level by level while they are few. Only rows below digests that differ are compared, so two equal
    tables of any size are read and not shuffled. The numbers of at most ``2**bits`` ranges are sent to tasks.
    """
    depth, differing = 0, None

    def below(df: DataFrame, at: Column) -> DataFrame:
        """Rows in a range that differs at the depth reached so far."""
        if differing is None:
            return df
        keep = F.broadcast(differing.select(F.col("node").alias("__node")))
        return df.join(keep, F.shiftrightunsigned(at, 64 - depth) == F.col("__node"), "left_semi")

    for _ in range(levels):
        sides = [_digests(below(_placed(df, key, ignore), F.col("__at")), depth + bits) for df in (a, b)]
        left, right = (side.select("node", F.struct("rows", "digest").alias(name)) for side, name in zip(sides, "lr"))
        finer = checkpointed(left.join(right, "node", "full").where(~F.col("l").eqNullSafe(F.col("r"))).select("node"), "ranges")
        count = finer.count()
        if not count:
            return replica_diff(a.where(F.lit(False)), b.where(F.lit(False)), key, ignore)
        if count > 1 << bits:
            break
        depth, differing = depth + bits, finer
    at = F.xxhash64(*key)
    return replica_diff(below(a, at), below(b, at), key, ignore).where("state <> 'equal'")


def key_collisions(
    a: DataFrame, b: DataFrame, key: Sequence[str], kind: str, ignore: Sequence[str] = ()
) -> DataFrame:
    """Keys both nodes inserted with different payload; ``kind`` is surrogate or natural."""
    cols = _payload(a, key, ignore)
    left = a.select(*key, F.struct(*cols).alias("row_a"))
    right = b.select(*key, F.struct(*cols).alias("row_b"))
    both = left.join(right, list(key))
    return both.where(~F.col("row_a").eqNullSafe(F.col("row_b"))).withColumn("kind", F.lit(kind))


def propose_resolution(collisions: DataFrame, created: str = "created") -> DataFrame:
    """The earlier row stays, the other is listed for repair; on a tie node A stays."""
    a_first = F.col(f"row_a.{created}") <= F.col(f"row_b.{created}")
    return collisions.withColumn("keep", F.when(a_first, "A").otherwise("B")).withColumn(
        "repair_on", F.when(a_first, "B").otherwise("A")
    )


def marker_lag(
    sent: DataFrame, seen: DataFrame, key: str = "marker", timeout_s: int = 20
) -> DataFrame:
    """Each marker written on one node with its delay on the other, in milliseconds.

    ``late`` arrived after the timeout, ``missing`` never did.
    """
    arrivals = seen.groupBy(F.col(key).alias("__m")).agg(F.min("ts").alias("__seen"))
    rows = sent.join(arrivals, F.col(key) == F.col("__m"), "left")
    lag = ((epoch_us("__seen") - epoch_us("ts")) / 1000).cast("long")
    state = (
        F.when(F.col("__seen").isNull(), "missing").when(lag > timeout_s * 1000, "late")
        .otherwise("ok")
    )
    return rows.select(key, lag.alias("lag_ms"), state.alias("state"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts per table and node (column ``node``), in one grouping over all tables; a node
    without rows of a table has no row."""
    out = None
    for table, df in tables.items():
        rows = df.select(F.lit(table).alias("table"), "node")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("table", "node").agg(F.count(F.lit(1)).alias("rows"))


def _key_sums(key: str) -> list[Column]:
    """Sums of the four 32-bit parts of each key's MD5; a null key adds nothing."""
    return [
        F.coalesce(
            F.sum(F.conv(F.substring(F.md5(F.col(key)), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")),
            F.lit(0),
        )
        for i in range(4)
    ]


def ordered_checksum(df: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Count and checksum of the keys of each group, equal on converged replicas.

    The checksum is the MD5 of the count and of four sums over the whole MD5 of every key. Sums
    do not depend on order and are combined in the reading tasks, so a group of any size costs
    one row per task, and the definition is the same at every size.
    """
    count = F.count(F.lit(1))
    parts = [c.cast("string") for c in (count, *_key_sums(key))]
    return df.groupBy(*group).agg(
        count.alias("keys"), F.md5(F.concat_ws(":", *parts)).alias("checksum")
    )


def set_checksum(df: DataFrame, key: str) -> DataFrame:
    """The same for a whole table."""
    return ordered_checksum(df, [], key)


def parity_report(
    df: DataFrame, offsets: Mapping[str, int], node: str = "node", id_col: str = "id", ring: int = 2
) -> DataFrame:
    """Ids per node and residue, with whether the residue is the node's own."""
    counted = df.groupBy(F.col(node).alias("node"), parity(id_col, ring).alias("parity")).agg(
        F.count(F.lit(1)).alias("ids")
    )
    own = F.create_map(*[F.lit(v) for n, o in offsets.items() for v in (n, o % ring)])
    mine = F.try_element_at(own, F.col("node"))
    return counted.withColumn("violation", (F.col("parity") != mine).cast("int"))


# -- writing rules ---------------------------------------------------------------------------


def insert_if_absent(new: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` to append: those whose key ``existing`` lacks, one per key.

    Of several new rows with one key the smallest is taken, so a rerun chooses the same. A null in a key is a value
    like others: such a row is appended once.
    """
    rest = [c for c in new.columns if c not in key]
    if rest:
        one = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__r")).select(
            *key, *[F.col(f"__r.{c}") for c in rest]
        ).select(*new.columns)
    else:
        one = new.distinct()
    have = existing.select(*[F.col(k).alias(f"__k_{k}") for k in key])
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key]
    return one.join(have, same, "left_anti").select(*new.columns)


def changed_only(new: DataFrame, old: DataFrame, key: Sequence[str]) -> DataFrame:
    """What a write of ``new`` over ``old`` must do per key.

    ``create`` a new key, ``replace`` one whose content differs, keeping the hash of the version
    it had; equal content is left out.
    """
    cols = _payload(new, key, ())
    fresh = new.select(*new.columns, row_hash(*cols).alias("hash"))
    kept = old.select(*[F.col(k).alias(f"__k_{k}") for k in key], row_hash(*cols).alias("previous"))
    on = None
    for k in key:
        part = F.col(k) == F.col(f"__k_{k}")
        on = part if on is None else on & part
    rows = fresh.join(kept, on, "left").drop(*[f"__k_{k}" for k in key])
    action = F.when(F.col("previous").isNull(), "create").when(
        F.col("previous") != F.col("hash"), "replace"
    )
    return rows.withColumn("action", action).where("action is not null")


def update_by_key(
    target: DataFrame, changes: DataFrame, key: str, values: Sequence[str], at: str,
    order: Sequence[str], modified: str = "modified",
) -> DataFrame:
    """``target`` with the latest change of each key applied; unknown keys have no effect.

    Keys are compared in lower case; a change to null is a change.
    """
    latest = changes.groupBy(F.lower(key).alias("__k")).agg(
        F.max_by(F.struct(*values, at), F.struct(*order)).alias("__c")
    )
    rows = target.join(latest, F.lower(key) == F.col("__k"), "left")
    changed = F.col("__k").isNotNull()
    cells: list[Column] = []
    for c in target.columns:
        source = c if c in values else at if c == modified else None
        if source is None:
            cells.append(F.col(c))
        else:
            new = F.col(f"__c.{source}").cast(target.schema[c].dataType)
            cells.append(F.when(changed, new).otherwise(F.col(c)).alias(c))
    return rows.select(*cells)


# -- ordering --------------------------------------------------------------------------------


def latest(df: DataFrame, order: str, n: int = 1) -> DataFrame:
    """The ``n`` rows with the highest ``order``: each task sends at most ``n`` rows."""
    return df.orderBy(F.col(order).desc()).limit(n)


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest ``order`` of each key, combined on the map side."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("__r")
    )
    return best.select(*key, *[F.col(f"__r.{c}") for c in rest])


def page(df: DataFrame, key: str, after: object = None, size: int = 50) -> DataFrame:
    """The next page in key order; it continues after a key, so it is stable under inserts."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def evidence(df: DataFrame, *key: str) -> DataFrame:
    return df.orderBy(*key)
