"""Continuous forms of the ordered rules: bans, alerts, limits, deliveries, sessions.

Each job gives what its batch form gives once all input is in. State is small and per key, and is
dropped by an event-time timeout when it can no longer matter. Rows of a key are first summed per
clock tick in the tasks that read them, so a busy source reaches its state as few rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailfleet.functions.scalars import epoch_s
from mailfleet.operators.abuse import (
    KNOWN_JAILS, RECIDIVE, Jail, enabled, hold_off, not_ignored,
)
from mailfleet.operators.messages import EXPIRE_AFTER_S, WARN_AFTER_S, vacation_candidates
from mailfleet.streaming.processors import Changes, Replies

TIMEOUT = GroupStateTimeout.EventTimeTimeout


def _ticks(df: DataFrame, keys: Sequence[str], tick: str, watermark: str, per_s: int) -> DataFrame:
    """Rows summed per key and tick within each Arrow batch of the reading task. The watermark
    is set on the summed rows (``at``); ``per_s`` is the number of ticks in a second."""
    names = [*keys, tick]

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby(names, as_index=False, sort=False, dropna=False)["n"].sum()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    summed = df.select(*keys, tick, F.lit(1).cast("bigint").alias("n")).mapInPandas(
        combine, f"{fields}, {tick} bigint, n bigint"
    )
    at = F.timestamp_millis(F.col(tick) * (1000 // per_s))
    return summed.withColumn("at", at).withWatermark("at", watermark)


def _in_order(batches: Iterator[pd.DataFrame], tick: str) -> pd.DataFrame:
    """Rows of one key in one trigger, one per tick. The trigger bounds them, and so does the
    clock."""
    rows = pd.concat(list(batches), ignore_index=True)
    return rows.groupby(tick, as_index=False)["n"].sum().sort_values(tick)


def _keep_until(state: GroupState, second: int) -> None:
    """Drops the state when event time passes ``second``."""
    state.setTimeoutTimestamp(max(second * 1000, state.getCurrentWatermarkMs() + 1))


# -- bans --------------------------------------------------------------------------------------


def ban_stream(
    fails: DataFrame, jails: Mapping[str, Jail] = KNOWN_JAILS, ignore: Sequence[str] = (),
    watermark: str = "5 minutes",
) -> DataFrame:
    """Bans (jail, ip, start, end) as failures (jail, ip, ts) come in.

    Seconds wait in the state until the watermark has passed them, so the order in which rows
    come does not matter within the watermark; an event-time timer wakes a key whose seconds have
    become final.
    """
    live = enabled(jails)
    rows = fails.where(F.col("jail").isin(*live))
    if ignore:
        rows = not_ignored(rows, ignore)
    rows = rows.select("jail", "ip", epoch_s("ts").alias("second"))
    return _folded_bans(_ticks(rows, ["jail", "ip"], "second", watermark, 1), live)


def _folded_bans(ticks: DataFrame, live: Mapping[str, Jail]) -> DataFrame:
    """Bans of failures summed per source and second (jail, ip, second, n), with a watermark."""
    params = {name: (j.maxretry, j.find_s, j.ban_s) for name, j in live.items()}

    def fold(key, batches, state: GroupState):
        maxretry, find_s, ban_s = params[key[0]]
        step = hold_off(maxretry, find_s, ban_s)
        held, waiting = {"until": -(2**62), "recent": []}, {}
        if state.exists:
            until, seconds, counts, ahead, ahead_counts = state.get
            held = {"until": until, "recent": list(zip(seconds, counts))}
            waiting = dict(zip(ahead, ahead_counts))
        if not state.hasTimedOut:
            for second, n in _in_order(batches, "second").itertuples(index=False, name=None):
                waiting[int(second)] = waiting.get(int(second), 0) + int(n)
        final = state.getCurrentWatermarkMs() // 1000
        out = []
        for second in sorted(s for s in waiting if s <= final):
            if step(held, second, waiting.pop(second)):
                out.append((*key, second, second + ban_s))
        recent = [(s, int(c)) for s, c in held["recent"]]
        if waiting or held["until"] > final or any(s + find_s >= final for s, _ in recent):
            state.update((
                held["until"], [s for s, _ in recent], [c for _, c in recent],
                list(waiting), list(waiting.values()),
            ))
            quiet = max([held["until"], *(s + find_s + 1 for s, _ in recent)])
            _keep_until(state, min(waiting) if waiting else quiet)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["jail", "ip", "start", "end"])

    return ticks.groupBy("jail", "ip").applyInPandasWithState(
        fold, "jail string, ip string, start bigint, end bigint",
        "until bigint, seconds array<bigint>, counts array<bigint>, ahead array<bigint>, "
        "ahead_counts array<bigint>", "append", TIMEOUT,
    )


def recidive_stream(
    bans: DataFrame, rule: Jail = RECIDIVE, watermark: str = "5 minutes"
) -> DataFrame:
    """Long bans of sources that were banned repeatedly, over the ban stream's table.

    A ban counts once, also where a trigger's folder was replaced and its rows are read again.
    """
    at = F.timestamp_seconds("start")
    once = bans.withColumn("ts", at).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["jail", "ip", "start"])
    ticks = once.select(
        F.lit("recidive").alias("jail"), "ip", F.col("start").alias("second"), F.lit(1).cast("bigint").alias("n"), "ts")
    return _folded_bans(ticks, {"recidive": rule})


# -- health ------------------------------------------------------------------------------------


def watchdog_stream(
    samples: DataFrame, width: str = "5 minutes", watermark: str = "300 seconds"
) -> DataFrame:
    """Worst values per node and window; samples later than the lag tolerance are dropped."""
    rows = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", width).alias("w"), "node").agg(
        F.count(F.lit(1)).alias("samples"), F.max("lag_s").alias("max_lag"),
        F.max("queued").alias("max_queued"),
        F.max((F.col("errno") != 0).cast("int")).alias("any_error"),
    ).select(epoch_s("w.start").alias("start"), "node", "samples", "max_lag", "max_queued",
             "any_error")


def alert_stream(
    samples: DataFrame, unit: str = "1 minute", watermark: str = "5 minutes"
) -> DataFrame:
    """One row per change of a node's state (columns node, sample_id, ts, state), the first compared
    with ``ok``.

    Samples are first reduced to one row per node and clock unit: its first and last state and the
    changes inside it, in the order of time, whatever the order of arrival. A unit is handed on when
    the watermark has passed it; what is carried over is one row per node and unit.
    """
    rows = samples.select(
        "node", F.col("ts").cast("timestamp").alias("ts"),
        F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "sample_id", "state").alias("s"),
    ).withWatermark("ts", watermark)
    units = rows.groupBy(F.window("ts", unit).alias("w"), "node").agg(F.array_sort(F.collect_list("s")).alias("all"))
    first, last = F.col("all")[0], F.element_at("all", -1)
    pairs = F.zip_with(
        F.slice("all", F.lit(1), F.size("all") - 1), F.slice("all", F.lit(2), F.size("all") - 1),
        lambda a, b: F.struct(
            b["sample_id"].alias("sample_id"), b["us"].alias("us"), a["state"].alias("before"), b["state"].alias("state")),
    )
    reduced = units.select(
        "node", F.unix_micros("w.start").alias("unit"), first["state"].alias("first"), first["sample_id"].alias("first_id"),
        first["us"].alias("first_us"), last["state"].alias("last"),
        F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["state"])).alias("inner"),
    )
    return reduced.groupBy("node").transformWithStateInPandas(
        Changes(), "node string, sample_id bigint, us bigint, before string, state string", "Append", "None")


def node_traffic_stream(
    access: DataFrame, width: str = "10 minutes", slide: str = "1 minute",
    watermark: str = "5 minutes",
) -> DataFrame:
    """Requests per node in sliding windows. Requests are counted per slide first, so a row
    enters one window and not one per slide."""
    rows = access.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    per_slide = rows.groupBy(F.window("ts", slide).alias("s"), "node").agg(
        F.count(F.lit(1)).alias("n")
    )
    at = F.window_time("s")
    return per_slide.groupBy(F.window(at, width, slide).alias("w"), "node").agg(
        F.sum("n").alias("requests")
    ).select(epoch_s("w.start").alias("start"), "node", "requests")


# -- replicas ----------------------------------------------------------------------------------


def marker_stream(
    sent: DataFrame, seen: DataFrame, within: str = "20 seconds", watermark: str = "1 hour"
) -> DataFrame:
    """Markers with the time they were seen on the other node, null when that is not within the
    deadline. Both sides are (marker, ts)."""
    a = sent.select("marker", F.col("ts").cast("timestamp").alias("sent_at")).withWatermark(
        "sent_at", watermark
    )
    b = seen.select(
        F.col("marker").alias("__m"), F.col("ts").cast("timestamp").alias("seen_at")
    ).withWatermark("seen_at", watermark)
    on = (
        (F.col("marker") == F.col("__m")) & (F.col("seen_at") >= F.col("sent_at"))
        & (F.col("seen_at") <= F.col("sent_at") + F.expr(f"interval {within}"))
    )
    joined = a.join(b, on, "left_outer")
    return joined.select(
        "marker", F.unix_micros("sent_at").alias("sent_us"), F.unix_micros("seen_at").alias("seen_us")
    )


# -- messages ----------------------------------------------------------------------------------


def sessions_stream(
    events: DataFrame, gap_s: int = 1800, watermark: str = "1 hour", named_gap_s: int = 86400
) -> DataFrame:
    """Closed sessions per user: by session id where there is one, else by a quiet gap.

    A session with an id is closed when it has been quiet for ``named_gap_s``, as in ``sessionize`` with
    that setting.
    """
    # In whole seconds, and a pause of exactly the gap ends a session: Spark's windows would still meet.
    whole = F.timestamp_seconds(epoch_s(F.col("ts").cast("timestamp")))
    rows = events.withColumn("ts", whole).withWatermark("ts", watermark)
    named, unnamed = (f"{s - 1}.999999 seconds" for s in (named_gap_s, gap_s))
    gap = F.when(F.col("session_id") != "", named).otherwise(unnamed)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "username", "session_id").agg(
        F.min(epoch_s("ts")).alias("start"), F.max(epoch_s("ts")).alias("end"),
        F.count(F.lit(1)).alias("events"),
    ).select("username", "session_id", "start", "end", "events")


def delivery_stream(
    queued: DataFrame, delivered: DataFrame, watermark: str = "1 hour"
) -> DataFrame:
    """Warnings, deliveries and bounces (queue_id, outcome, second) of queued messages.

    Both inputs are (queue_id, ts). A deadline is the time bound of an outer join: no delivery
    within the warning time gives a warning, none within the lifetime a bounce. State and timers
    are Spark's own; a message leaves the state when event time passes its deadline.
    """
    start = queued.select("queue_id", F.col("ts").cast("timestamp").alias("queued_at"))
    end = delivered.select(
        F.col("queue_id").alias("__id"), F.col("ts").cast("timestamp").alias("done_at")
    )

    def within(seconds: int) -> DataFrame:
        on = (
            (F.col("queue_id") == F.col("__id")) & (F.col("done_at") >= F.col("queued_at"))
            & (F.col("done_at") < F.col("queued_at") + F.expr(f"interval {seconds} seconds"))
        )
        return start.withWatermark("queued_at", watermark).join(
            end.withWatermark("done_at", watermark), on, "left_outer"
        )

    began = epoch_s("queued_at")
    warned = within(WARN_AFTER_S).where("done_at is null").select(
        "queue_id", F.lit("warned").alias("outcome"), (began + WARN_AFTER_S).alias("second")
    )
    in_time = F.col("done_at").isNotNull()
    ended = within(EXPIRE_AFTER_S).select(
        "queue_id", F.when(in_time, "delivered").otherwise("bounced").alias("outcome"),
        F.when(in_time, epoch_s("done_at")).otherwise(began + EXPIRE_AFTER_S).alias("second"),
    )
    return warned.unionByName(ended)


def vacation_stream(
    msgs: DataFrame, vacation: DataFrame, notified: DataFrame | None = None, watermark: str = "1 hour"
) -> DataFrame:
    """Vacation replies (rcpt, sender, second) as messages come in, by the order of their times.

    ``notified`` (on_vacation, notified, notified_at) are replies that were sent before the stream began; they are the
    state it begins with. A row of it for somebody who is not away silences nothing and is left out.
    """
    # Every message moves the watermark, also one to somebody who is not away.
    timed = msgs.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark)
    rows = vacation_candidates(timed, vacation, keep_end=True).select(
        "rcpt", "sender", F.col("interval_time").cast("bigint").alias("interval_s"),
        epoch_s("ts").alias("second"), epoch_s("activeuntil").alias("ends"), "at",
    )
    begin = None
    if notified is not None:
        away = vacation.where("active = 1").select(
            F.lower("email").alias("__e"), F.col("interval_time").cast("bigint").alias("interval_s"),
            epoch_s("activeuntil").alias("ends"),
        )
        begin = notified.groupBy(F.lower("on_vacation").alias("rcpt"), F.lower("notified").alias("sender")).agg(
            F.max(epoch_s("notified_at")).alias("noted")
        ).join(away, F.col("rcpt") == F.col("__e")).groupBy("rcpt", "sender").agg(
            F.max("noted").alias("noted"), F.max("interval_s").alias("interval_s"), F.max("ends").alias("ends")
        ).groupBy("rcpt", "sender")
    return rows.groupBy("rcpt", "sender").transformWithStateInPandas(
        Replies(), "rcpt string, sender string, second bigint", "Append", "EventTime", begin)
