"""Bans, rate limits and reputation over authentication and access logs.

A source may produce a third of all lines. Counters therefore work on sums per (source, second),
built on the map side, and time cuts every source into slices.
"""

from __future__ import annotations

import ipaddress
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailfleet.functions.rules import first_match
from mailfleet.functions.scalars import epoch_s, in_ipv6_ranges, in_ranges, ip_to_long, ipv6_hex, seconds_of
from mailfleet.plans.fold import sequential
from mailfleet.plans.jumps import along, jump_tables
from mailfleet.plans.scan import (
    SPANS_PER_SLICE, balanced, first_at_or_after, per_second, running, segments, time_chunk, trailing_count,
)
from mailfleet.plans.session import checkpointed


@dataclass(frozen=True)
class Jail:
    maxretry: int = 5
    findtime: str = "10m"
    bantime: str = "1h"
    enabled: bool = True

    @property
    def find_s(self) -> int:
        return seconds_of(self.findtime)

    @property
    def ban_s(self) -> int:
        return seconds_of(self.bantime)


# The jails and their thresholds.
JAILS: dict[str, Jail] = {
    "sshd": Jail(maxretry=4, bantime="4h"),
    "smtp": Jail(),
    "smtp-sasl": Jail(maxretry=4, bantime="6h"),
    "smtp-rbl": Jail(enabled=False),
    "dovecot": Jail(maxretry=5, bantime="4h"),
    "imap-ext": Jail(maxretry=8, findtime="20m", bantime="2h"),
    "admin": Jail(maxretry=4, bantime="12h"),
    "webmail": Jail(maxretry=6, bantime="4h"),
    "web-limit": Jail(maxretry=20, findtime="5m", bantime="1h"),
    "web-bad-request": Jail(maxretry=20),
}
# The names under which stock configurations write the same jails.
STOCK_NAMES = {
    "postfix": "smtp",
    "postfix-sasl": "smtp-sasl",
    "postfix-rbl": "smtp-rbl",
    "postfixadmin": "admin",
    "roundcube-auth": "webmail",
    "nginx-limit-req": "web-limit",
    "nginx-bad-request": "web-bad-request",
}
KNOWN_JAILS = JAILS | {stock: JAILS[name] for stock, name in STOCK_NAMES.items()}
RECIDIVE = Jail(maxretry=4, findtime="1d", bantime="7d")

# Reputation lists with their weights, and the two thresholds.
LIST_WEIGHTS = {
    "zen": 3, "spamcop": 2, "barracuda": 2, "dnswl0": -2, "dnswl1": -4, "dnswl2": -6, "dnswl3": -8,
}
BLOCK_AT = 3
ALLOW_AT = -2

# Client rates per minute, error limits of a session, logins per minute.
CLIENT_LIMITS = {"connection": 100, "message": 200, "submission": 100}
SOFT_ERRORS = 10
HARD_ERRORS = 20
LOGINS_PER_MINUTE = 3
CONCURRENT_LIMITS = {"smtp": 50, "submission": 20, "smtps": 20}

STRETCH = ["jail", "ip", "stretch"]
# Seconds of an unbroken stretch that one task folds.
LONGEST_STRETCH = 200_000
# Ignored networks that become literal conditions; longer lists are searched.
MOST_LITERALS = 32


def _param(table: Mapping[str, Jail], jail: str, value) -> Column:
    """A jail setting as an expression over the jail name; the rule table needs no join."""
    cells = [F.lit(x) for name, j in table.items() for x in (name, value(j))]
    return F.try_element_at(F.create_map(*cells), F.col(jail))


def enabled(jails: Mapping[str, Jail]) -> dict[str, Jail]:
    return {name: j for name, j in jails.items() if j.enabled}


# -- sources ---------------------------------------------------------------------------------


def disjoint_ranges(networks: Sequence[str]) -> list[tuple[str, str]]:
    """Listed hosts and networks as sorted ranges that do not meet, bounds included; an address is its family and 32 hex digits."""
    spans = sorted(
        (net.version, int(net.network_address), int(net.broadcast_address))
        for net in (ipaddress.ip_network(text, strict=False) for text in networks))
    merged: list[list[int]] = []
    for version, lo, hi in spans:
        if merged and merged[-1][0] == version and lo <= merged[-1][2] + 1:
            merged[-1][2] = max(merged[-1][2], hi)
        else:
            merged.append([version, lo, hi])
    return [(f"{v}{lo:032x}", f"{v}{hi:032x}") for v, lo, hi in merged]


def _ignored_sources(sources: DataFrame, ranges: Sequence[tuple[str, str]]) -> DataFrame:
    """The texts (``__ip``) among ``sources`` that are addresses within one of the ranges; one binary search each."""
    number = ip_to_long("__ip")
    address = F.coalesce(
        F.concat(F.lit("4"), F.lpad(F.lower(F.hex(number)), 32, "0")), F.concat(F.lit("6"), ipv6_hex("__ip")))
    low, high = (np.array(side, "S33") for side in zip(*ranges))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array(batch.column(1).to_pylist(), "S33")
            place = np.searchsorted(low, at, side="right") - 1
            inside = (place >= 0) & (at <= high[np.maximum(place, 0)])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(inside))], ["__ip"])

    return sources.select("__ip", address.alias("a")).where("a is not null").mapInArrow(search, "__ip string")


def not_ignored(df: DataFrame, ignore: Sequence[str], ip: str = "ip") -> DataFrame:
    """Rows whose source is neither a listed host nor in a listed subnet; text that is no address is kept.

    The list is merged to sorted ranges that do not meet. A short one becomes conditions of the scan; of a long
    one each distinct source is looked up once, and the rows of those found are left out by a join.
    """
    ranges = disjoint_ranges(ignore)
    if len(ranges) > MOST_LITERALS and not df.isStreaming:
        found = _ignored_sources(df.select(F.col(ip).alias("__ip")).where("__ip is not null").distinct(), ranges)
        return df.join(found, F.col(ip) == F.col("__ip"), "left_anti")
    v4 = [entry for entry in ignore if ":" not in entry]
    v6 = [entry for entry in ignore if ":" in entry]
    return df.where(~(in_ranges(ip, v4) | in_ipv6_ranges(ip, v6)))


def top_sources(fails: DataFrame, k: int, jail: str = "jail", ip: str = "ip") -> DataFrame:
    """The ``k`` busiest sources of each jail; ties go to the lower address.

    Spark keeps at most ``k`` rows per jail in every task before the shuffle.
    """
    counted = fails.groupBy(F.col(jail).alias("jail"), F.col(ip).alias("ip")).agg(
        F.count(F.lit(1)).alias("failures")
    )
    w = Window.partitionBy("jail").orderBy(F.col("failures").desc(), F.col("ip").asc())
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reputation_score(
    hits: DataFrame, weights: Mapping[str, int] = LIST_WEIGHTS, ip: str = "ip",
    list_name: str = "list_name",
) -> DataFrame:
    """Summed list weights per client, each list once: block, allow or neutral."""
    cells = [F.lit(x) for pair in weights.items() for x in pair]
    weight = F.try_element_at(F.create_map(*cells), F.col(list_name))
    scored = (
        hits.select(F.col(ip).alias("ip"), F.col(list_name).alias("list"), weight.alias("w"))
        .where("w is not null").distinct().groupBy("ip").agg(F.sum("w").alias("score"))
    )
    verdict = F.when(F.col("score") >= BLOCK_AT, "block").when(
        F.col("score") <= ALLOW_AT, "allow"
    )
    return scored.withColumn("verdict", verdict.otherwise("neutral"))


# -- bans ------------------------------------------------------------------------------------


def ban_events(fails: DataFrame, jails: Mapping[str, Jail] = KNOWN_JAILS) -> DataFrame:
    """Every second at which a source has at least ``maxretry`` failures within ``findtime``."""
    live = enabled(jails)
    rows = fails.where(F.col("jail").isin(*live))
    seconds = per_second(rows, ["jail", "ip"], "ts")
    unit = math.lcm(*[j.find_s for j in live.values()])
    counted = trailing_count(
        seconds, ["jail", "ip"], _param(live, "jail", lambda j: j.find_s), unit, "failures"
    )
    return counted.where(F.col("failures") >= _param(live, "jail", lambda j: j.maxretry)).select(
        "jail", "ip", "second", "failures"
    )


def recidive(bans: DataFrame, rule: Jail = RECIDIVE) -> DataFrame:
    """Sources banned at least ``maxretry`` times within ``findtime`` over all jails, at each
    second where that holds, with the end of the long ban."""
    seconds = bans.groupBy("ip", "second").agg(F.count(F.lit(1)).alias("n"))
    counted = trailing_count(seconds, ["ip"], F.lit(rule.find_s), rule.find_s, "bans")
    return counted.where(F.col("bans") >= rule.maxretry).select(
        "ip", "second", "bans", (F.col("second") + rule.ban_s).alias("until")
    )


def hold_off(maxretry: int, find_s: int, hold_s: int):
    """Sequential ban rule over (second, n) rows: counts failures in the last ``find_s`` seconds,
    bans when they reach ``maxretry``, then forgets them and sees nothing until the ban ends."""

    def step(state: dict, second: int, n: int) -> bool:
        if second < state["until"]:
            return False
        recent = [(s, c) for s, c in state["recent"] if s >= second - find_s]
        recent.append((second, n))
        if sum(c for _, c in recent) >= maxretry:
            state["until"], state["recent"] = second + hold_s, []
            return True
        state["recent"] = recent
        return False

    return step


def new_state() -> dict:
    return {"until": -(2**62), "recent": []}


def ban_ledger(
    fails: DataFrame, jails: Mapping[str, Jail] = KNOWN_JAILS, longest: int = LONGEST_STRETCH
) -> DataFrame:
    """Exact bans (jail, ip, start, end): a ban clears the counter and hides what follows.

    Sources are cut where they are quiet for longer than both times, which resets them, so one
    source can be many independent units of work, folded where they lie. A stretch of more than ``longest``
    seconds is no unit: its bans are found by pointers (``_bans_by_pointers``), which gives the same.
    """
    live = enabled(jails)
    params = {name: (j.maxretry, j.find_s, j.ban_s) for name, j in live.items()}
    rows = fails.where(F.col("jail").isin(*live))
    seconds = per_second(rows, ["jail", "ip"], "ts")
    quiet = _param(live, "jail", lambda j: max(j.find_s + 1, j.ban_s))
    cut = checkpointed(segments(
        seconds, ["jail", "ip"], "second", F.floor(F.col("second") / 86400), quiet, "stretch"
    ), "stretches")

    # Most sources never fail often enough; they do not leave Spark.
    sizes = cut.groupBy("jail", "ip", "stretch").agg(F.sum("n").alias("__fails"), F.count(F.lit(1)).alias("__rows")).where(
        F.col("__fails") >= _param(live, "jail", lambda j: j.maxretry))

    def of_size(wanted: Column) -> DataFrame:
        keys = sizes.where(wanted).select(*[F.col(c).alias(f"__{c}") for c in STRETCH])
        return cut.join(keys, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in STRETCH], "left_semi")

    def fold(key, group):
        maxretry, find_s, ban_s = params[key[0]]
        step, state = hold_off(maxretry, find_s, ban_s), new_state()
        for second, n in group:
            if step(state, second, n):
                yield second, second + ban_s

    bans = sequential(
        of_size(F.col("__rows") <= longest).select(*STRETCH, "second", "n"), ["jail", "ip"], ["second"], fold,
        "jail string, ip string, start bigint, end bigint", spread=["stretch"],
    )
    if sizes.where(F.col("__rows") > longest).isEmpty():
        return bans
    return bans.unionByName(_bans_by_pointers(of_size(F.col("__rows") > longest), live))


def _latest_starts(maxretry: Mapping[str, int], find: Mapping[str, int]):
    """For one slice of a stretch: each second that can end a ban, with the latest start that still leads to it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("second")
        jail = rows["jail"].iloc[0]
        second, total = rows["second"].to_numpy(), rows["n"].to_numpy().cumsum()
        start = np.searchsorted(total - rows["n"].to_numpy(), total - maxretry[jail], side="right") - 1
        latest = np.where(start >= 0, second[np.maximum(start, 0)], -(2**62))
        rows = rows.assign(latest=latest)
        hot = (latest >= second - find[jail]) & (rows["__slice"] == rows["__own"]).to_numpy()
        return rows.loc[hot, [*STRETCH, "second", "latest"]]

    return run


def _bans_by_pointers(rows: DataFrame, live: Mapping[str, Jail]) -> DataFrame:
    """Bans of long stretches (jail, ip, stretch, second, n), each of which is many tasks.

    From a fresh counter at second ``s`` the ban comes at the first second whose count over the span, from ``s`` on, is enough;
    that is the first whose latest possible start is not before ``s``. The counter is fresh again at the first second after that ban, so
    each second points to another. Which seconds are starts follows by pointer doubling from the stretch's first.
    """
    live = dict(live)
    maxretry, find = {k: j.maxretry for k, j in live.items()}, {k: j.find_s for k, j in live.items()}
    find_s, ban_s = _param(live, "jail", lambda j: j.find_s), _param(live, "jail", lambda j: j.ban_s)
    length = find_s * SPANS_PER_SLICE
    own = F.floor(F.col("second") / length)
    near_end = F.col("second") >= (own + 1) * length - find_s
    rows = checkpointed(rows.select(*STRETCH, "second", "n"), "long-stretches")
    sliced = rows.select("*", own.alias("__own"), F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))).alias("__slice"))
    # A slice holds a bounded number of seconds, whatever its source does.
    hot = sliced.groupBy(*STRETCH, "__slice").applyInPandas(
        _latest_starts(maxretry, find), "jail string, ip string, stretch bigint, second bigint, latest bigint")
    day = 86400
    banned = first_at_or_after(rows.drop("n"), hot, STRETCH, F.col("second"), "latest", "second", day, "ban").where("ban is not null")
    fresh = checkpointed(first_at_or_after(
        banned, rows, STRETCH, F.col("ban") + ban_s, "second", "second", day, "next"), "ban-pointers")
    node = F.struct(*STRETCH, "second")
    jumps = jump_tables(fresh.where("next is not null").select(
        node.alias("src"), F.struct(*STRETCH, F.col("next").alias("second")).alias("dst")))
    first = rows.groupBy(*STRETCH).agg(F.min("second").alias("second"))
    starts = along(first.select(F.lit(0).alias("origin"), node.alias("at"), F.lit(0).cast("bigint").alias("depth")), jumps)
    return fresh.join(starts.select(F.col("at").alias("__at")), node == F.col("__at"), "left_semi").select(
        "jail", "ip", F.col("ban").alias("start"), (F.col("ban") + ban_s).alias("end"))


def unknown_jails(fails: DataFrame, jails: Mapping[str, Jail] = KNOWN_JAILS) -> DataFrame:
    """``jail, rows`` of failures that no rule covers: jails that are not listed (null is one), which other operators leave out."""
    known = F.coalesce(F.col("jail").isin(*jails), F.lit(False))
    return fails.where(~known).groupBy("jail").agg(F.count(F.lit(1)).alias("rows"))


def requests_while_banned(
    requests: DataFrame, bans: DataFrame, slice_s: int = 3600, ts: str = "ts"
) -> DataFrame:
    """Requests whose source is banned at that time: ``start <= ts < end``.

    Bans are cut into hours, and those of an hour are merged to intervals that do not meet, so a
    request is tried against few of them. Matching by (source, hour) spreads a busy source over
    its hours; an hour has at most one ban start per second after the first grouping.
    """
    hours = F.sequence(
        F.floor(F.col("start") / slice_s), F.floor((F.col("end") - 1) / slice_s)
    )
    pieces = bans.select(
        F.col("ip").alias("__ip"), "start", "end", F.explode(hours).alias("__hour")
    ).select(
        "__ip", "__hour", F.greatest("start", F.col("__hour") * slice_s).alias("start"),
        F.least("end", (F.col("__hour") + 1) * slice_s).alias("end"),
    ).groupBy("__ip", "__hour", "start").agg(F.max("end").alias("end"))
    w = Window.partitionBy("__ip", "__hour").orderBy("start")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before >= F.col("start"), 0).otherwise(1)
    held = pieces.withColumn("__opens", opens).withColumn(
        "__island", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy("__ip", "__hour", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    at = epoch_s(ts)
    cond = (
        (F.col("ip") == F.col("__ip")) & (F.floor(at / slice_s) == F.col("__hour"))
        & (at >= F.col("start")) & (at < F.col("end"))
    )
    return requests.join(held, cond, "left_semi")


# -- rates -----------------------------------------------------------------------------------


def rate_violations(
    events: DataFrame, limits: Mapping[str, int] = CLIENT_LIMITS, unit_s: int = 60,
    client: str = "ip", kind: str = "kind", ts: str = "ts",
) -> DataFrame:
    """Clients above the limit of their event kind in a clock unit."""
    cells = [F.lit(x) for pair in limits.items() for x in pair]
    limit = F.try_element_at(F.create_map(*cells), F.col("kind"))
    counted = events.groupBy(
        F.col(client).alias("ip"), F.col(kind).alias("kind"),
        (F.floor(epoch_s(ts) / unit_s) * unit_s).alias("unit_start"),
    ).agg(F.count(F.lit(1)).alias("events"))
    return counted.where(F.col("events") > limit)


def concurrent_connections(
    connections: DataFrame, limits: Mapping[str, int] = CONCURRENT_LIMITS, chunk_s: int = 3600
) -> DataFrame:
    """First second at which a client has more connections open at a service than its limit, and the most it ever has.

    ``connections`` is (ip, service, opened, closed), ``closed`` null while it is open. A connection holds its place from the second it
    opens to the one before it closes. Opens and closes are summed per client and second on the map side; the level is a running
    sum whose hours are scanned apart and carried over, so a busy client is many tasks. Services without a limit are left out.
    """
    cells = [F.lit(x) for pair in limits.items() for x in pair]
    keys = ["ip", "service"]
    steps = connections.where(F.col("service").isin(*limits)).select(*keys, F.inline(F.array(
        F.struct(epoch_s("opened").alias("second"), F.lit(1).alias("step")),
        F.struct(epoch_s("closed").alias("second"), F.lit(-1).alias("step")),
    ))).where("second is not null").groupBy(*keys, "second").agg(F.sum("step").alias("step"))
    level = running(steps, keys, ["second"], F.floor(F.col("second") / chunk_s), F.col("step"), "open")
    over = level.where(F.col("open") > F.try_element_at(F.create_map(*cells), F.col("service")))
    return over.groupBy(*keys).agg(F.min("second").alias("second"), F.max("open").alias("most"))


def error_limits(
    events: DataFrame, session: str, order: Sequence[str], is_error: Column,
    soft: int = SOFT_ERRORS, hard: int = HARD_ERRORS, chunk_s: int = 3600, ts: str = "ts",
) -> DataFrame:
    """The event at which a session passes its soft limit, and the one at which it reaches the
    hard limit. The error count is carried over hours, so a long session is not one task."""
    cut = balanced(events.where(is_error), [session], order, time_chunk(ts, chunk_s), "chunk")
    counted = running(cut, [session], order, F.col("chunk"), F.lit(1), "errors").drop("chunk")
    crossed = F.when(F.col("errors") == soft + 1, "soft").when(F.col("errors") == hard, "hard")
    return counted.withColumn("limit", crossed).where("limit is not null")


def login_rate(
    events: DataFrame, user: str = "user_id", limit: int = LOGINS_PER_MINUTE, span_s: int = 60,
    ts: str = "ts",
) -> DataFrame:
    """Seconds at which a user has more than ``limit`` logins in the trailing span."""
    seconds = per_second(events, [user], ts)
    counted = trailing_count(seconds, [user], F.lit(span_s), span_s, "logins")
    return counted.where(F.col("logins") > limit).select(user, "second", "logins")


# -- session checks --------------------------------------------------------------------------

Rule = tuple[str, Column, str]


def smtp_rules() -> dict[str, list[tuple[str, list[Rule]]]]:
    """Ordered restriction lists of the services, over the flags of a session."""
    c = F.col
    trusted = [("permit_mynetworks", c("in_networks"), "permit")]
    login = [("permit_sasl_authenticated", c("sasl_ok"), "permit")]
    owner = [("reject_sender_login_mismatch", c("login_mismatch"), "reject")]
    early = [("reject_unauth_pipelining", c("pipelining"), "reject")]
    nothing_else = [("reject", F.lit(True), "reject")]

    def reject(name: str, flag: Column) -> Rule:
        return (f"reject_{name}", flag, "reject")

    submission = [
        ("client", [*login, *nothing_else]),
        ("sender", [*owner, *login, *nothing_else]),
        ("relay", [*login, *nothing_else]),
        ("recipient", [*login, *nothing_else]),
        ("data", early),
    ]
    return {
        "smtp": [
            ("client", [*trusted, *login, reject("unknown_client_hostname", c("client_unknown"))]),
            ("helo", [
                *trusted, *login, reject("invalid_helo_hostname", c("helo_invalid")),
                reject("non_fqdn_helo_hostname", c("helo_not_fqdn")),
            ]),
            ("sender", [
                *trusted, *owner, *login, reject("non_fqdn_sender", c("sender_not_fqdn")),
                reject("unknown_sender_domain", c("sender_domain_unknown")),
            ]),
            ("relay", [*trusted, *login, reject("unauth_destination", ~c("dest_local"))]),
            ("recipient", [
                *trusted, *login, reject("non_fqdn_recipient", c("rcpt_not_fqdn")),
                reject("unknown_recipient_domain", c("rcpt_domain_unknown")),
                reject("unlisted_recipient", c("rcpt_unlisted")),
                ("check_policy_service", c("spf_fail"), "reject"),
            ]),
            ("data", early),
        ],
        "submission": submission,
        "smtps": submission,
    }


def restriction_chain(
    sessions: DataFrame, rules: Mapping[str, list[tuple[str, list[Rule]]]] | None = None,
    service: str = "service",
) -> DataFrame:
    """Verdict of each session with the rule that decided.

    In every list the first rule that holds counts: a permit ends that list, a reject ends the
    session. One projection, however long the lists are. A service without lists is rejected.
    """
    rules = rules or smtp_rules()
    known = F.coalesce(F.col(service).isin(*rules), F.lit(False))
    deciders = [(~known, F.lit("service:unknown"))]
    for name, lists in rules.items():
        stops = []
        for list_name, chain in lists:
            hit = first_match([
                (cond, f"{list_name}:{rule}" if action == "reject" else None)
                for rule, cond, action in chain
            ])
            stops.append(hit.cast("string"))
        deciders.append((F.col(service) == name, F.coalesce(*stops)))
    decided = first_match(deciders).cast("string")
    return sessions.withColumn("decided_by", F.coalesce(decided, F.lit("permit"))).withColumn(
        "verdict", F.when(decided.isNull(), "permit").otherwise("reject")
    )
