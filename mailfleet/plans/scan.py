"""Ordered scans that do not put a whole key into one task.

A window partitioned by a node, a source or a user sends all rows of that key to one task. Here
the key is cut into chunks by a column that rises with the order (an hour, a day, a block of
ids). Rows are scanned within (key, chunk); one summary row per (key, chunk) is scanned across
chunks; its result is carried back to the rows. The summary has one row per chunk, so it is
bounded by the covered range and not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailfleet.functions.scalars import ColumnOrName, col, epoch_s
from mailfleet.plans.session import checkpointed

_CHUNK, _CARRY = "__chunk", "__carry"

# Rows of one (key, chunk) that a single task may scan.
MOST_ROWS = 5_000_000

# Length of a slice of a trailing count, in spans; one span of every slice is repeated.
SPANS_PER_SLICE = 6


def time_chunk(ts: ColumnOrName, seconds: int) -> Column:
    return F.floor(epoch_s(ts) / seconds)


def id_chunk(c: ColumnOrName, size: int) -> Column:
    return F.floor(col(c) / size)


def range_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "chunk",
    parts: int | None = None,
) -> DataFrame:
    """Adds a chunk number of about equal row count, for data that crowds into a few hours.

    Rows are range-partitioned by key and order, so a hot key is cut by its order wherever its
    rows are. The numbers depend on sampled bounds; the result is therefore written once to the
    shared folder and read back, and every later use sees the same numbers.
    """
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return checkpointed(ranged.withColumn(out, F.spark_partition_id()), "chunks")


def balanced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, out: str,
    most: int = MOST_ROWS,
) -> DataFrame:
    """Adds a chunk column with which no (key, chunk) holds more than about ``most`` rows.

    That is ``chunk`` while it is fine enough, which one count per (key, chunk) tells; if a
    single hour of a single key is crowded beyond that, chunks of equal row count replace it.
    """
    cut = df.withColumn(out, chunk)
    sizes = cut.groupBy(*keys, out).count().agg(
        F.coalesce(F.max("count"), F.lit(0)).alias("top"), F.sum("count").alias("rows")
    ).first()
    if sizes.top <= most:
        return cut
    return range_chunks(df, keys, order, out, parts=2 * sizes.rows // most + 1)


def _carry_back(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [*keys, _CHUNK]
    cond = None
    right = summary.select(*[F.col(k).alias(f"__r_{k}") for k in on], _CARRY)
    for k in on:
        part = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = part if cond is None else cond & part
    return rows.join(right, cond, "left").drop(*[f"__r_{k}" for k in on])


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: Column,
    out: str,
    backward: bool = False,
) -> DataFrame:
    """Adds the value of the row before (or after) each row of its key, null at the end."""
    rows = df.withColumn(_CHUNK, chunk).withColumn("__v", F.struct(value.alias("v")))
    ordering = [F.col(o).desc() if backward else F.col(o).asc() for o in order]
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*ordering)
    rows = rows.withColumn("__prev", F.lag("__v").over(local))
    last = F.min_by if backward else F.max_by
    edge = rows.groupBy(*keys, _CHUNK).agg(
        last("__v", F.struct(*[F.col(o) for o in order])).alias("__edge")
    )
    side = F.col(_CHUNK).desc() if backward else F.col(_CHUNK).asc()
    across = Window.partitionBy(*keys).orderBy(side)
    edge = edge.withColumn(_CARRY, F.lag("__edge").over(across))
    merged = _carry_back(rows, edge, keys)
    return merged.withColumn(out, F.coalesce("__prev", _CARRY)["v"]).drop(
        _CHUNK, _CARRY, "__v", "__prev"
    )


def following(df, keys, order, chunk, value, out) -> DataFrame:
    """Adds the value of the next row of the same key."""
    return previous(df, keys, order, chunk, value, out, backward=True)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    value: Column,
    out: str,
    how: str = "sum",
    before: bool = False,
) -> DataFrame:
    """Adds the running sum or maximum of ``value`` up to each row, without the row itself when
    ``before`` is set."""
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn(_CHUNK, chunk).withColumn("__v", value)
    local = (
        Window.partitionBy(*keys, _CHUNK).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    )
    rows = rows.withColumn("__run", fold("__v").over(local))
    totals = rows.groupBy(*keys, _CHUNK).agg(fold("__v").alias("__total"))
    across = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = totals.withColumn(_CARRY, fold("__total").over(across))
    merged = _carry_back(rows, totals, keys)
    if how == "sum":
        total = F.coalesce("__run", F.lit(0)) + F.coalesce(_CARRY, F.lit(0))
    else:
        total = F.greatest("__run", _CARRY)
    return merged.withColumn(out, total).drop(_CHUNK, _CARRY, "__v", "__run")


def first_at_or_after(
    df: DataFrame, points: DataFrame, keys: Sequence[str], at: Column, pos: str, value: str, chunk_s: int, out: str,
) -> DataFrame:
    """Adds the ``value`` of the first point of the same key at ``pos >= at``, null if there is none.

    Values must not fall as ``pos`` rises, so the first is the least of all later ones: a running minimum from the end over
    rows and points together, whose chunks are scanned apart and carried over.
    """
    held = points.select(*keys, (-F.col(pos)).alias("__o"), F.lit(0).alias("__q"), (-F.col(value)).alias("__p"))
    asked = df.select(F.struct("*").alias("__row"), *keys, (-at).alias("__o"), F.lit(1).alias("__q"), F.lit(None).cast("bigint").alias("__p"))
    both = asked.unionByName(held, True)
    found = running(both, keys, ["__o", "__q"], F.floor(F.col("__o") / chunk_s), F.col("__p"), "__found", how="max")
    return found.where("__q = 1").select("__row.*", (-F.col("__found")).alias(out))


def growth(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: Column, before: str, streak: str,
) -> DataFrame:
    """Adds the value of the row before and how many rows in a row it has grown up to each row.

    A chunk is summed up in one row that can be put together with its neighbours: first and last value,
    length, streak at its end, and whether it grows throughout. One scan over these tells each chunk
    what it continues; its leading rows, up to the first that did not grow, take that on.
    """
    rows = df.withColumn(_CHUNK, chunk).withColumn("__v", value)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__i", F.row_number().over(w)).withColumn("__b", F.lag("__v").over(w))
    grown = F.coalesce(F.col("__v") > F.col("__b"), F.lit(False))
    rows = rows.withColumn("__reset", F.max(F.when((F.col("__i") > 1) & ~grown, F.col("__i"))).over(upto))
    rows = rows.withColumn("__s", (F.col("__i") - F.coalesce("__reset", F.lit(1))).cast("bigint"))
    by = F.struct(*[F.col(o) for o in order])
    summary = rows.groupBy(*keys, _CHUNK).agg(
        F.min_by(F.struct("__v"), by).alias("__first"), F.max_by(F.struct("__v", "__s"), by).alias("__last"),
        F.count(F.lit(1)).alias("__n"), F.max("__reset").isNull().alias("__whole"),
    )
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    so_far = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = summary.withColumn("__prior", F.lag("__last").over(across))
    joins = F.coalesce(F.col("__first")["__v"] > F.col("__prior")["__v"], F.lit(False))
    summary = summary.withColumn("__joins", joins).withColumn("__whole", F.col("__whole") & F.col("__joins"))
    # The streak at a chunk's end: that of the last chunk with a break, and the lengths of those after it.
    summary = summary.withColumn("__sum", F.sum(F.when(F.col("__whole"), F.col("__n")).otherwise(0)).over(so_far))
    ended = F.when(~F.col("__whole"), F.col("__last")["__s"] - F.col("__sum"))
    summary = summary.withColumn("__end", F.col("__sum") + F.last(ended, True).over(so_far))
    summary = summary.withColumn(_CARRY, F.struct(
        F.col("__prior")["__v"].alias("v"),
        F.when(F.col("__joins"), F.lag("__end").over(across) + 1).otherwise(0).alias("s")))
    merged = _carry_back(rows, summary, keys)
    leading = F.when(F.col("__reset").isNull(), F.col(_CARRY)["s"]).otherwise(0)
    return merged.withColumn(before, F.when(F.col("__i") == 1, F.col(_CARRY)["v"]).otherwise(F.col("__b"))).withColumn(
        streak, F.col("__s") + leading).drop(_CHUNK, _CARRY, "__v", "__i", "__b", "__reset", "__s")


def per_second(df: DataFrame, keys: Sequence[str], ts: ColumnOrName) -> DataFrame:
    """Rows per key and whole second. Log lines carry whole seconds, so nothing is lost; the sum
    runs on the map side and bounds a busy key by the clock instead of by its rows."""
    return df.groupBy(*keys, epoch_s(ts).alias("second")).agg(F.count(F.lit(1)).alias("n"))


def trailing_count(
    seconds: DataFrame, keys: Sequence[str], span_s: Column, unit: int, out: str
) -> DataFrame:
    """Adds to per-second counts the rows of the key in ``[second - span_s, second]``.

    ``unit`` is a common multiple of all spans, so that one frame fits keys with different spans.
    A key is cut into slices of a few spans, and the last span of each slice is repeated in the
    next one as context: a task holds a bounded number of seconds of a key.
    """
    length = span_s * SPANS_PER_SLICE
    own = F.floor(F.col("second") / length)
    near_end = F.col("second") >= (own + 1) * length - span_s
    sliced = seconds.select(
        "*",
        (F.col("second") * (F.lit(unit) / span_s).cast("long")).alias("__pos"),
        own.alias("__own"),
        F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))).alias("__slice"),
    )
    w = Window.partitionBy(*keys, "__slice").orderBy("__pos").rangeBetween(-unit, 0)
    counted = sliced.withColumn(out, F.sum("n").over(w))
    return counted.where(F.col("__slice") == F.col("__own")).drop("__pos", "__own", "__slice")


def segments(
    df: DataFrame, keys: Sequence[str], order: str, chunk: Column, gap: Column, out: str
) -> DataFrame:
    """Numbers the stretches of a key that are separated by at least ``gap`` in ``order``.

    ``gap`` may differ by key. Starts are counted within each chunk; whether a chunk's first row
    starts a stretch follows from the end of the chunk before it.
    """
    rows = df.withColumn(_CHUNK, chunk).withColumn("__gap", gap)
    w = Window.partitionBy(*keys, _CHUNK).orderBy(order)
    step = F.col(order) - F.lag(order).over(w)
    rows = rows.withColumn("__start", F.coalesce((step >= F.col("__gap")).cast("int"), F.lit(0)))
    rows = rows.withColumn("__run", F.sum("__start").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ))
    edges = rows.groupBy(*keys, _CHUNK).agg(
        F.min(order).alias("__first"), F.max(order).alias("__last"),
        F.sum("__start").alias("__inner"), F.max("__gap").alias("__gap"),
    )
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    quiet = F.col("__first") - F.lag("__last").over(across) >= F.col("__gap")
    edges = edges.withColumn("__opens", F.coalesce(quiet.cast("int"), F.lit(1)))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = F.coalesce(F.sum(F.col("__inner") + F.col("__opens")).over(before), F.lit(0))
    edges = edges.withColumn(_CARRY, carry + F.col("__opens"))
    merged = _carry_back(rows, edges, keys)
    return merged.withColumn(out, F.col(_CARRY) + F.col("__run")).drop(
        _CHUNK, _CARRY, "__gap", "__start", "__run"
    )
