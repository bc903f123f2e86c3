"""Streaming queries: each runs a stream over the data folder until it has read everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailfleet.catalog.abuse import DAILY, LEDGER, RECIDIVE_LEDGER, WIDE
from mailfleet.catalog.health import STATES, states
from mailfleet.catalog.messages import MERGED, SESSIONS, stores
from mailfleet.catalog.registry import query
from mailfleet.operators.health import transitions
from mailfleet.plans.session import shared_folder
from mailfleet.sources.fixtures import Views
from mailfleet.sources.schema import conform
from mailfleet.streaming import jobs, store
from mailfleet.streaming.processors import ROCKSDB
from mailfleet.streaming.runs import (
    CLOSING, StreamViews, few_partitions, last_update, replayed, run_available, run_closed,
)


def live(v: Views, *tables: str) -> StreamViews:
    return StreamViews(v.spark, v.folder, tables)


def _fails(s: StreamViews):
    return s("fx_auth").where("outcome = 'fail'").select("jail", "ip", "ts")


def _bans(v):
    """All bans of the stream; a closing row of a source of its own makes every second final."""
    jail = sorted(WIDE)[0]
    end = {"jail": jail, "ip": "closing", "ts": CLOSING}
    rows = run_closed(lambda f: jobs.ban_stream(f, WIDE), [_fails(live(v, "events"))], [end], "bans")
    return rows.where("ip is distinct from 'closing'").drop("batch_id")


@query("str01_ban_stream", LEDGER + "select jail, ip, start, \"end\" from ledger")
def _(v):
    return _bans(v)


@query("str02_recidive_stream", RECIDIVE_LEDGER)
def _(v):
    path = shared_folder(v.spark, "bans")
    bans = _bans(v)
    bans.write.parquet(path)
    source = v.spark.readStream.schema(bans.schema).parquet(path)
    end = {"jail": "recidive", "ip": "closing", "start": int(CLOSING.timestamp()), "end": 0}
    rows = run_closed(lambda b: jobs.recidive_stream(b, DAILY), [source], [end], "recidive")
    return rows.where("ip is distinct from 'closing'").drop("batch_id")


@query("str03_watchdog_stream", """
select cast(floor(epoch(ts) / 300) as bigint) * 300 as start, node, count(*) as samples, max(lag_s) as max_lag, max(queued) as max_queued, max(case when errno <> 0 then 1 else 0 end) as any_error from fx_sample group by 1, 2""")
def _(v):
    rows = run_available(jobs.watchdog_stream(live(v, "events")("fx_sample")), "watch", "update")
    return last_update(rows, ["start", "node"])


@query("str03_health_stream", """
select cast(floor(epoch(ts) / 900) as bigint) * 900 as start, node, count(*) as samples, max(lag_s) as max_lag, max(queued) as max_queued, max(case when errno <> 0 then 1 else 0 end) as any_error from fx_sample group by 1, 2""")
def _(v):
    stream = jobs.watchdog_stream(live(v, "events")("fx_sample"), "15 minutes")
    return last_update(run_available(stream, "health", "update"), ["start", "node"])


def _alerts(v, **run):
    end = {"node": "closing", "sample_id": -1, "ts": CLOSING, "state": "ok"}
    rows = run_closed(
        jobs.alert_stream, [states(live(v, "events"))], [end], "alerts", settings=ROCKSDB, **run)
    return rows.where("node <> 'closing'")


@query("str04_alert_stream", STATES + """
select node, sample_id, epoch_us(ts) as us, before, state from p where state <> before""")
def _(v):
    return _alerts(v).drop("batch_id")


@query("snk04_alert_sink", STATES + "select node, sample_id, before, state from p where state <> before")
def _(v):
    path = shared_folder(v.spark, "alert-sink")
    return _alerts(v, path=path, write=store.alert_writer(path)).select("node", "sample_id", "before", "state")


@query("str05_marker_stream", """
with s as (select natural_key as marker, created + interval '1' second * cast(id % 41 as int) as ts from fx_log_b)
select a.natural_key as marker, epoch_us(a.created) as sent_us, epoch_us(s.ts) as seen_us
from fx_log_a a left join s on s.marker = a.natural_key and s.ts between a.created and a.created + interval '20' second""")
def _(v):
    s = live(v, "orders")
    sent = s.sql("select natural_key as marker, created as ts from fx_log_a")
    seen = s.sql(
        "select natural_key as marker, created + interval '1' second * cast(id % 41 as int) as ts "
        "from fx_log_b"
    )
    end = {"marker": "closing", "ts": CLOSING}
    rows = run_closed(jobs.marker_stream, [sent, seen], [end, end], "markers")
    return rows.where("marker <> 'closing'").drop("batch_id")


@query("str07_message_state_stream", MERGED + "select username, guid, modseq, flags, folder, expunged from merged")
def _(v):
    changes = live(v, "documents")("fx_msg")
    return store.message_state_stream(changes, shared_folder(v.spark, "messages"))


@query("str08_reconcile", MERGED + """
select username, guid, case when guid % 6 = 0 then 'add' else 'update' end as repair, modseq, flags, folder, expunged from merged where guid % 6 = 0 or guid % 7 = 1
union all select username, -1 - guid, 'remove', null, null, null, null from merged where guid % 50 = 0""")
def _(v):
    a, b = stores(v)
    kept = store.message_state_stream(
        live(v, "documents")("fx_msg"), shared_folder(v.spark, "messages")
    )
    # Some notifications were lost, and some states are behind.
    lost = kept.where(F.col("guid") % 6 != 0).withColumn(
        "modseq", F.col("modseq") - F.when(F.col("guid") % 7 == 1, 1).otherwise(0)
    )
    # Some states are of messages that no store holds.
    orphans = kept.where(F.col("guid") % 50 == 0).withColumn("guid", -1 - F.col("guid"))
    return store.reconcile(a, b, lost.unionByName(orphans))


@query("str09_delivery_stream", """
with a as (select queue_id, cast(epoch(queued_at) as bigint) as q, delivered_after_h * 3600 as s, queued_at from fx_delivery)
select queue_id, 'warned' as outcome, q + 14400 as second from a where s is null or s >= 14400 union all select queue_id, 'delivered', q + s from a where s < 259200
union all select queue_id, 'bounced', q + 259200 from a where s is null or s >= 259200""")
def _(v):
    queued = v.sql("select queue_id, queued_at as ts from fx_delivery")
    done = v.sql(
        "select queue_id, queued_at + interval '1' hour * delivered_after_h as ts "
        "from fx_delivery where delivered_after_h is not null"
    )
    end = {"queue_id": -1, "ts": CLOSING}
    streams = replayed([queued, done], "ts", "delivery")
    rows = run_closed(
        jobs.delivery_stream, streams, [end, end], "delivery", settings=few_partitions(v.spark))
    return rows.where("queue_id >= 0").drop("batch_id")


@query("str10_sessions_stream", SESSIONS)
def _(v):
    end = {"event_id": -1, "ts": CLOSING, "username": "closing", "session_id": ""}
    rows = run_closed(
        lambda events: jobs.sessions_stream(events, 14400), [live(v, "events")("fx_session")],
        [end], "sessions",
    )
    return rows.where("username <> 'closing'").drop("batch_id")


@query("str11_node_traffic_stream", """
with m as (select case when event_id % 2 = 0 then 'sg1' else 'us1' end as node, cast(floor(epoch(ts) / 60) as bigint) * 60 as minute from events),
w as (select node, minute - 60 * unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) as start from m)
select start, node, count(*) as requests from w group by 1, 2""")
def _(v):
    access = live(v, "events").sql(
        "select ts, case when event_id % 2 = 0 then 'sg1' else 'us1' end as node from events"
    )
    rows = run_closed(
        jobs.node_traffic_stream, [access], [{"ts": CLOSING, "node": "closing"}], "traffic"
    )
    return rows.where("node <> 'closing'").drop("batch_id")


@query("str12_vacation_stream", """
with recursive cand as (
 select distinct m.rcpt, m.sender, cast(floor(epoch(m.ts)) as bigint) as second, cast(v.interval_time as bigint) as gap
 from fx_vacation_msg m join fx_vacation v on v.email = m.rcpt and v.active = 1 and m.ts between v.activefrom and v.activeuntil
 where not exists (select 1 from fx_notified n where n.on_vacation = m.rcpt and n.notified = m.sender and floor(epoch(m.ts)) >= floor(epoch(n.notified_at))
   and (v.interval_time = 0 or floor(epoch(m.ts)) < floor(epoch(n.notified_at)) + v.interval_time))),
nxt as (select a.rcpt, a.sender, a.second, (select min(b.second) from cand b where b.rcpt = a.rcpt and b.sender = a.sender and a.gap > 0 and b.second >= a.second + a.gap) as next_second from cand a),
walk as (select rcpt, sender, min(second) as second from cand group by 1, 2
 union all select w.rcpt, w.sender, x.next_second from walk w join nxt x on x.rcpt = w.rcpt and x.sender = w.sender and x.second = w.second where x.next_second is not null)
select rcpt, sender, second from walk""")
def _(v):
    vacation = conform(v("fx_vacation"), "vacation")
    end = {"msg_id": -1, "ts": CLOSING, "rcpt": "closing", "sender": "closing"}
    rows = run_closed(
        lambda m: jobs.vacation_stream(m, vacation, v("fx_notified")), [live(v, "events")("fx_vacation_msg")], [end],
        "vacation", settings=ROCKSDB)
    return rows.drop("batch_id")


@query("win02_alert_history", STATES + """
select node, count(*) filter (state = 'problem') as raised, count(*) filter (state = 'ok') as cleared from p where state <> before group by node""")
def _(v):
    return transitions(states(v)).groupBy("node").agg(
        F.count_if(F.col("state") == "problem").alias("raised"),
        F.count_if(F.col("state") == "ok").alias("cleared"),
    )
