"""Abuse queries: log parsing, bans, rates, reputation, session checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailfleet.catalog.registry import query
from mailfleet.functions import scalars as S
from mailfleet.functions.rules import FILTERS, compile_filters
from mailfleet.operators import abuse as A
from mailfleet.operators.health import node_traffic
from mailfleet.sources.fixtures import Views
from mailfleet.sources.logs import (
    parse_access_log, parse_admin_auth, parse_imap_auth, parse_webmail_auth,
)

# The data has few failures per hour; thresholds are arguments, so these queries use wide ones.
WIDE = {
    "dovecot": A.Jail(maxretry=4, findtime="1d", bantime="4h"),
    "webmail": A.Jail(maxretry=4, findtime="1d", bantime="4h"),
    "admin": A.Jail(maxretry=3, findtime="12h", bantime="12h"),
}
DAILY = A.Jail(maxretry=2, findtime="1d", bantime="7d")
IGNORED = ("127.0.0.1/8", "::1", "203.0.113.10", "203.0.113.16/30")

TRIPS = """
with f as (select jail, ip, cast(floor(epoch(ts)) as bigint) as s from fx_auth where outcome = 'fail'),
c as (select jail, ip, s, count(*) over (partition by jail, ip order by s range between 86400 preceding and current row) as n1,
 count(*) over (partition by jail, ip order by s range between 43200 preceding and current row) as n2 from f),
trips as (select distinct jail, ip, s as second, case jail when 'admin' then n2 else n1 end as failures from c where (jail = 'admin' and n2 >= 3) or (jail <> 'admin' and n1 >= 4))
"""

# Exact bans: from each possible ban, the next second at which failures since its end suffice.
LEDGER = TRIPS.replace("\nwith f as", "\nwith recursive f as").rstrip() + """,
cfg(jail, need, find, hold) as (values ('dovecot', 4, 86400, 14400), ('webmail', 4, 86400, 14400), ('admin', 3, 43200, 43200)),
nxt as (select a.jail, a.ip, a.second, min(b.second) as next_second from trips a join cfg c on c.jail = a.jail join trips b on b.jail = a.jail and b.ip = a.ip and b.second >= a.second + c.hold
 where (select count(*) from f where f.jail = b.jail and f.ip = b.ip and f.s between greatest(a.second + c.hold, b.second - c.find) and b.second) >= c.need group by 1, 2, 3),
walk as (select jail, ip, min(second) as second from trips group by 1, 2 union all select w.jail, w.ip, x.next_second from walk w join nxt x on x.jail = w.jail and x.ip = w.ip and x.second = w.second),
ledger as (select w.jail, w.ip, w.second as start, w.second + c.hold as "end" from walk w join cfg c on c.jail = w.jail)
"""
RECIDIVE_LEDGER = LEDGER.rstrip() + """,
rt as (select distinct ip, start as second, count(*) over (partition by ip order by start range between 86400 preceding and current row) as n from ledger),
rn as (select a.ip, a.second, min(b.second) as next_second from rt a join rt b on b.ip = a.ip and b.n >= 2 and b.second >= a.second + 604800
 where (select count(*) from ledger l where l.ip = b.ip and l.start between greatest(a.second + 604800, b.second - 86400) and b.second) >= 2 and a.n >= 2 group by 1, 2),
rw as (select ip, min(second) as second from rt where n >= 2 group by 1 union all select w.ip, x.next_second from rw w join rn x on x.ip = w.ip and x.second = w.second)
select 'recidive' as jail, ip, second as start, second + 604800 as "end" from rw
"""

def fails(v: Views):
    return v("fx_auth").where("outcome = 'fail'").select("jail", "ip", "ts")


_TS = "cast(floor(epoch(e.ts)) as bigint)"


@query("src02_parse_access_log", f"""
select l.event_id, '203.0.113.' || cast(e.user_id % 40 as varchar) as ip, {_TS} as second, case when e.event_type in ('error', 'signup') then 'POST' else 'GET' end as method,
 case when e.event_type not in ('error', 'signup') then '/index.php' when e.event_id % 5 = 0 then '/users/password-recover.php?x=1' else '/login.php' end as path,
 case when e.event_type = 'signup' then 302 else 200 end as status, e.event_id % 5000 as bytes, cast('0.' || cast(100 + e.event_id % 900 as varchar) as double) as rt, case when e.event_id % 2 = 0 then 'sg1' else 'us1' end as node, '-' as referer, 'agent' as agent
from fx_access_line l join events e on e.event_id = l.event_id""")
def _(v):
    rows = parse_access_log(v("fx_access_line"), keep=("event_id",))
    return rows.withColumn("second", S.epoch_s("ts")).drop("ts", "remote_user", "request")


@query("src03_parse_webmail_auth", f"""
select event_id, 'webmail' as jail, {_TS} as second, '203.0.113.' || cast(user_id % 40 as varchar) as ip, cast(1 + event_id % 3 as int) as shape, 'u' || cast(user_id as varchar) || '@d1.example.com' as user from events e where event_type = 'error'""")
def _(v):
    rows = parse_webmail_auth(v("fx_webmail_line"), keep=("event_id",))
    return rows.withColumn("second", S.epoch_s("ts")).drop("ts")


@query("src03_parse_admin_auth", f"""
select event_id, 'admin' as jail, {_TS} as second, '203.0.113.' || cast(user_id % 40 as varchar) as ip, case when event_id % 5 = 0 then 2 else 1 end as shape from events e where event_type = 'error'""")
def _(v):
    rows = parse_admin_auth(v("fx_access_line"), keep=("event_id",))
    return rows.withColumn("second", S.epoch_s("ts")).drop("ts")


@query("src04_parse_imap_auth", f"""
select event_id, 'imap-ext' as jail, {_TS} as second, '203.0.113.' || cast(user_id % 40 as varchar) as ip, case event_id % 4 when 2 then 2 when 3 then 4 else 1 end as shape,
 case when event_id % 4 = 0 then 'u' || cast(user_id as varchar) || '@d1.example.com' end as user, case when event_id % 4 <> 2 then 'x' || cast(event_id as varchar) end as session from events e where event_type = 'error'""")
def _(v):
    rows = parse_imap_auth(v("fx_imap_line"), keep=("event_id",))
    return rows.withColumn("second", S.epoch_s("ts")).drop("ts")


@query("scl09_log_times", """
select event_id, cast(floor(epoch(ts)) as bigint) as access_s, cast(floor(epoch(ts)) as bigint) as webmail_s, cast(floor(epoch(ts)) as bigint) as imap_s from events""")
def _(v):
    parsed = {
        "access": v("fx_access_line"), "webmail": v("fx_webmail_line"), "imap": v("fx_imap_line")
    }
    filters = {f.kind: c for f, c in zip(FILTERS, compile_filters().values())}
    out = None
    for kind, lines in parsed.items():
        part = lines.select("event_id", S.epoch_s(filters[kind].ts).alias(f"{kind}_s"))
        out = part if out is None else out.join(part, "event_id")
    return out


@query("udf01_compiled_filters", """
select jail, cast(sum(hit) as bigint) as failures, count(*) as lines from (
 select 'admin' as jail, case when event_type = 'error' then 1 else 0 end as hit from events union all
 select 'webmail', case when event_type = 'error' then 1 else 0 end from events union all
 select 'imap-ext', case when event_type = 'error' then 1 else 0 end from events) group by jail""")
def _(v):
    lines = {"admin": "fx_access_line", "webmail": "fx_webmail_line", "imap-ext": "fx_imap_line"}
    out = None
    for jail, compiled in compile_filters().items():
        part = v(lines[jail]).select(F.lit(jail).alias("jail"), compiled.is_failure.alias("hit"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("jail").agg(
        F.count_if("hit").alias("failures"), F.count(F.lit(1)).alias("lines")
    )


@query("fil11_restriction_chain", """
with f as (select *, case
 when service not in ('smtp', 'submission', 'smtps') then 'service:unknown'
 when service in ('submission', 'smtps') then (case when not sasl_ok then 'client:reject' when login_mismatch then 'sender:reject_sender_login_mismatch' when pipelining then 'data:reject_unauth_pipelining' end)
 when in_networks then (case when pipelining then 'data:reject_unauth_pipelining' end)
 when not sasl_ok and client_unknown then 'client:reject_unknown_client_hostname'
 when not sasl_ok and helo_invalid then 'helo:reject_invalid_helo_hostname' when not sasl_ok and helo_not_fqdn then 'helo:reject_non_fqdn_helo_hostname'
 when login_mismatch then 'sender:reject_sender_login_mismatch' when not sasl_ok and sender_not_fqdn then 'sender:reject_non_fqdn_sender' when not sasl_ok and sender_domain_unknown then 'sender:reject_unknown_sender_domain'
 when not sasl_ok and not dest_local then 'relay:reject_unauth_destination'
 when not sasl_ok and rcpt_not_fqdn then 'recipient:reject_non_fqdn_recipient' when not sasl_ok and rcpt_domain_unknown then 'recipient:reject_unknown_recipient_domain'
 when not sasl_ok and rcpt_unlisted then 'recipient:reject_unlisted_recipient' when not sasl_ok and spf_fail then 'recipient:check_policy_service'
 when pipelining then 'data:reject_unauth_pipelining' end as why from fx_smtp)
select session_no, coalesce(why, 'permit') as decided_by, case when why is null then 'permit' else 'reject' end as verdict from f""")
def _(v):
    return A.restriction_chain(v("fx_smtp")).select("session_no", "decided_by", "verdict")


@query("fil12_not_ignored", """
select event_id, ip from fx_auth where not (ip = '203.0.113.10' or ip in ('203.0.113.16', '203.0.113.17', '203.0.113.18', '203.0.113.19'))""")
def _(v):
    return A.not_ignored(v("fx_auth"), IGNORED).select("event_id", "ip")


@query("win05_ban_events", TRIPS + "select jail, ip, second, failures from trips")
def _(v):
    return A.ban_events(fails(v), WIDE)


@query("win06_recidive", TRIPS + """
select ip, second, bans, second + 604800 as until from (
 select distinct ip, second, count(*) over (partition by ip order by second range between 86400 preceding and current row) as bans from trips) where bans >= 2""")
def _(v):
    return A.recidive(A.ban_events(fails(v), WIDE), DAILY)


@query("str01_ban_ledger", LEDGER + "select jail, ip, start, \"end\" from ledger")
def _(v):
    return A.ban_ledger(fails(v), WIDE)


@query("str02_recidive_ledger", RECIDIVE_LEDGER)
def _(v):
    bans = A.ban_ledger(fails(v), WIDE).select(
        F.lit("recidive").alias("jail"), "ip", F.timestamp_seconds("start").alias("ts")
    )
    return A.ban_ledger(bans, {"recidive": DAILY})


@query("join18_requests_while_banned", TRIPS + """,
bans as (select ip, second as start, second + 14400 as stop from trips)
select event_id, ip from fx_auth a where exists (select 1 from bans b where b.ip = a.ip and floor(epoch(a.ts)) >= b.start and floor(epoch(a.ts)) < b.stop)""")
def _(v):
    bans = A.ban_events(fails(v), WIDE).select(
        "ip", F.col("second").alias("start"), (F.col("second") + 14400).alias("end")
    )
    return A.requests_while_banned(v("fx_auth"), bans).select("event_id", "ip")


@query("sort03_top_sources", """
select jail, ip, failures, cast(rank as int) as rank from (select jail, ip, count(*) as failures, row_number() over (partition by jail order by count(*) desc, ip) as rank from fx_auth where outcome = 'fail' group by 1, 2) where rank <= 5""")
def _(v):
    return A.top_sources(fails(v), 5)


@query("agg08_reputation_score", """
with h as (select distinct ip, list_name from fx_dnsbl)
select ip, cast(sum(w) as bigint) as score, case when sum(w) >= 3 then 'block' when sum(w) <= -2 then 'allow' else 'neutral' end as verdict
from h join (values ('zen', 3), ('spamcop', 2), ('barracuda', 2), ('dnswl2', -6)) t(l, w) on l = list_name group by ip""")
def _(v):
    return A.reputation_score(v("fx_dnsbl"))


@query("win08_rate_violations", """
select ip, kind, cast(floor(epoch(ts) / 21600) as bigint) * 21600 as unit_start, count(*) as events from fx_client
group by 1, 2, 3 having count(*) > case kind when 'connection' then 2 when 'message' then 3 else 5 end""")
def _(v):
    limits = {"connection": 2, "message": 3, "submission": 5}
    return A.rate_violations(v("fx_client"), limits, unit_s=21600)


@query("win08_concurrent_connections", """
with c as (select ip, case when event_id % 3 = 0 then 'submission' else 'smtp' end as service, cast(floor(epoch(ts)) as bigint) as s,
  case when event_id % 19 <> 0 then cast(floor(epoch(ts)) as bigint) + event_id % 7 * 14400 end as t from fx_client),
e as (select ip, service, s as second, 1 as step from c union all select ip, service, t, -1 from c where t is not null),
n as (select ip, service, second, sum(step) as step from e group by all),
l as (select *, sum(step) over (partition by ip, service order by second) as open from n)
select ip, service, min(second) as second, cast(max(open) as bigint) as most from l where open > case service when 'smtp' then 5 else 2 end group by ip, service""")
def _(v):
    rows = v("fx_client").select(
        "ip", F.when(F.col("event_id") % 3 == 0, "submission").otherwise("smtp").alias("service"),
        F.timestamp_seconds(S.epoch_s("ts")).alias("opened"),
        F.when(F.col("event_id") % 19 != 0, F.timestamp_seconds(S.epoch_s("ts") + F.col("event_id") % 7 * 14400)).alias("closed"))
    return A.concurrent_connections(rows, {"smtp": 5, "submission": 2})


@query("win05_unknown_jails", """
select jail, count(*) as rows from (select case when event_id % 7 = 0 then 'own-' || jail when event_id % 11 = 0 then null else jail end as jail from fx_auth where outcome = 'fail')
where jail is null or jail like 'own-%' group by jail""")
def _(v):
    own = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("own-"), "jail")).when(F.col("event_id") % 11 != 0, F.col("jail"))
    return A.unknown_jails(v("fx_auth").where("outcome = 'fail'").withColumn("jail", own))


@query("fil12_large_ignore_list", """
select event_id, ip from fx_auth where not (ip like '203.0.113.%' and cast(split_part(ip, '.', 4) as int) % 3 = 0)""")
def _(v):
    others = [f"10.{o // 250}.{o % 250}.0/25" for o in range(3000)]
    return A.not_ignored(v("fx_auth"), [*others, *[f"203.0.113.{h}" for h in range(0, 256, 3)]]).select("event_id", "ip")


@query("win09_error_limits", """
with e as (select event_id, user_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as errors from fx_auth where outcome = 'fail')
select event_id, user_id, errors, case when errors = 11 then 'soft' else 'hard' end as "limit" from e where errors in (11, 20)""")
def _(v):
    rows = A.error_limits(
        v("fx_auth"), "user_id", ["ts", "event_id"], F.col("outcome") == "fail"
    )
    return rows.select("event_id", "user_id", "errors", "limit")


@query("win10_login_rate", """
with s as (select user_id, cast(floor(epoch(ts)) as bigint) as second from fx_auth),
c as (select user_id, second, count(*) over (partition by user_id order by second range between 43200 preceding and current row) as logins from s)
select distinct user_id, second, logins from c where logins > 3""")
def _(v):
    return A.login_rate(v("fx_auth"), span_s=43200)


@query("agg13_node_traffic", """
select cast(floor(epoch(a.ts) / 60) as bigint) * 60 as minute, case when event_id % 2 = 0 then 'sg1' else 'us1' end as node, case when event_type = 'signup' then 302 else 200 end as status, count(*) as requests,
 round(quantile_cont(cast('0.' || cast(100 + event_id % 900 as varchar) as double), 0.95), 6) as p95_rt from events a group by 1, 2, 3""")
def _(v):
    return node_traffic(parse_access_log(v("fx_access_line")))
