"""Health queries: status dumps, problems, trends, reports, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailfleet.catalog.registry import query
from mailfleet.functions import scalars as S
from mailfleet.operators import health as H
from mailfleet.sources.fixtures import Views
from mailfleet.sources.status import STATUS_KEYS, parse_queue_status, parse_status_dump

_DUMP = """
with st as (select e.event_id as sample_id, case when event_id % 2 = 0 then 'A' else 'B' end as node, case when event_id % 41 = 0 then 'No' else 'Yes' end as io, case when event_type = 'error' and event_id % 97 = 0 then 'No' else 'Yes' end as sq,
 case when event_id % 53 = 0 then null else cast(floor(value * 2) as bigint) end as lag, case when event_type = 'error' and event_id % 97 = 0 then 1062 when event_id % 101 = 0 then 1032 else 0 end as errno,
 cast(floor(value * 3) as bigint) as sync, event_id % 5 as high, case when event_id % 31 = 0 then 0 else event_id % 17 end as low, case when event_id % 43 = 0 then 2 else 0 end as failed_q, event_id % 3 as full_q, case when event_id % 43 = 0 then 1 else 0 end as waiting from events e)
"""


@query("src06_parse_status_dump", _DUMP + """
select sample_id, io as "Slave_IO_Running", sq as "Slave_SQL_Running", coalesce(cast(lag as varchar), 'NULL') as "Seconds_Behind_Master", cast(errno as varchar) as "Last_Errno",
 case when errno = 1062 then 'Duplicate entry ' || cast(sample_id as varchar) || ' for key PRIMARY' else '' end as "Last_Error", case when io = 'No' then 'error connecting: retry' else '' end as "Last_IO_Error", '1-1-' || cast(sample_id as varchar) as "Gtid_IO_Pos" from st""")
def _(v):
    return parse_status_dump(v("fx_status_text"), STATUS_KEYS, keep=("sample_id",))


@query("src07_parse_queue_status", _DUMP + """
select sample_id, 'queued' as state, 'sync' as class, sync as requests from st union all select sample_id, 'queued', 'high', high from st union all select sample_id, 'queued', 'low', low from st
union all select sample_id, 'queued', 'failed', failed_q from st union all select sample_id, 'queued', 'full resync', full_q from st union all select sample_id, 'waiting', 'failed', waiting from st""")
def _(v):
    return parse_queue_status(v("fx_queue_text"), keep=("sample_id",))


@query("agg10_queue_totals", _DUMP + "select sample_id, node, sync + high + low + failed_q + full_q as queued, sync, cast(waiting as bigint) as failed from st")
def _(v):
    return H.queue_totals(parse_queue_status(v("fx_queue_text"), keep=("sample_id", "node")))


def replica_samples(v: Views):
    """Status dump and queue totals of each sample side by side."""
    status = parse_status_dump(v("fx_status_text"), keep=("sample_id", "node"))
    queue = H.queue_totals(parse_queue_status(v("fx_queue_text"), keep=("sample_id",)), ["sample_id"])
    return status.join(queue, "sample_id")


@query("fil16_replica_problems", _DUMP + """,
q as (select *, sync + high + low + failed_q + full_q as queued from st)
select sample_id, node, 'io thread stopped' as problem from q where io <> 'Yes' union all select sample_id, node, 'sql thread stopped' from q where sq <> 'Yes'
union all select sample_id, node, 'duplicate key: both nodes wrote the same row' from q where errno = 1062 union all select sample_id, node, 'replica error ' || cast(errno as varchar) from q where errno not in (0, 1062)
union all select sample_id, node, 'lag unknown while running' from q where lag is null and io = 'Yes' and sq = 'Yes' union all select sample_id, node, 'lag ' || cast(lag as varchar) || 's' from q where lag > 300
union all select sample_id, node, 'queue ' || cast(queued as varchar) from q where queued > 500 union all select sample_id, node, cast(waiting as varchar) || ' failed requests' from q where waiting > 0""")
def _(v):
    return H.replica_problems(replica_samples(v))


@query("fil14_host_preflight", """
select host_no, 'error' as severity, 'too little memory' as finding from fx_host where ram_mb < 1800 union all select host_no, 'warn', 'little memory' from fx_host where ram_mb between 1800 and 3799
union all select host_no, 'error', 'too little disk' from fx_host where disk_gb < 10 union all select host_no, 'warn', 'untested system version' from fx_host where os_version <> '24.04'
union all select host_no, 'warn', 'clock not synchronised' from fx_host where host_no % 19 = 0""")
def _(v):
    hosts = v("fx_host").withColumn("ntp_synced", (F.col("host_no") % 19 != 0).cast("int"))
    return H.host_preflight(hosts)


_BAND = """case when queued > 500 then 'error' when queued > 100 then 'warn' else 'ok' end as queue_state, case when disk_pct > 92 then 'error' when disk_pct > 85 then 'warn' else 'ok' end as disk_state,
 case when lag_s > 300 then 'error' else 'ok' end as lag_state, case when errno <> 0 then 'error' else 'ok' end as errno_state"""
_CHECKS = f"""
with b as (select sample_id, node, {_BAND} from fx_sample),
checks as (select node, sample_id, 'queue' as "check", queue_state as status from b union all select node, sample_id, 'disk', disk_state from b
 union all select node, sample_id, 'lag', lag_state from b union all select node, sample_id, 'errno', errno_state from b)
"""


@query("fil15_severity_bands", f"select sample_id, queue_state, disk_state from (select sample_id, {_BAND} from fx_sample)")
def _(v):
    return H.severity_bands(v("fx_sample")).select("sample_id", "queue_state", "disk_state")


@query("fil17_port_findings", """
select host_no, port, case when port in (110, 995, 3306, 11334, 12345) then 'exposed' else 'unreachable' end as finding from fx_host
where (port in (110, 995, 3306, 11334, 12345) and reachable_public = 1) or (port in (22, 25, 80, 143, 443, 465, 587, 4190) and reachable_public = 0)""")
def _(v):
    return H.port_findings(v("fx_host"))


@query("set02_all_checks", _CHECKS + 'select node, sample_id, "check", status from checks')
def _(v):
    return H.sample_checks(v("fx_sample"))


@query("agg07_health_rollup", _CHECKS + """
select node, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'warn') as warn, count(*) filter (status = 'error') as error,
 case when count(*) filter (status = 'error') > 0 then 2 when count(*) filter (status = 'warn') > 0 then 1 else 0 end as exit_code from checks group by node""")
def _(v):
    return H.health_rollup(H.sample_checks(v("fx_sample")))


@query("agg07_sample_status", _CHECKS + """
select node, sample_id, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'warn') as warn, count(*) filter (status = 'error') as error,
 case when count(*) filter (status = 'error') > 0 then 2 when count(*) filter (status = 'warn') > 0 then 1 else 0 end as exit_code from checks group by node, sample_id""")
def _(v):
    return H.health_rollup(H.sample_checks(v("fx_sample")), ["node", "sample_id"])


@query("snk03_health_report", f"""
with b as (select sample_id, node, {_BAND} from fx_sample),
c as (select sample_id, node, unnest([1, 2, 3, 4]) as i, unnest(['queue', 'disk', 'lag', 'errno']) as name, unnest([queue_state, disk_state, lag_state, errno_state]) as status from b)
select sample_id, '{{"node":"' || node || '","hostname":"' || lower(node) || '.example.com","ok":' || cast(count(*) filter (status = 'ok') as varchar) || ',"warn":' || cast(count(*) filter (status = 'warn') as varchar) || ',"error":' || cast(count(*) filter (status = 'error') as varchar)
 || ',"problems":[' || coalesce(string_agg('"' || name || ': ' || status || '"', ',' order by case status when 'error' then 0 else 1 end, i) filter (status <> 'ok'), '') || ']}}' as report from c group by sample_id, node""")
def _(v):
    named = F.concat(F.lower("node"), F.lit(".example.com"))
    return H.health_report(v("fx_sample").withColumn("hostname", named))


def states(v: Views):
    bad = (F.col("lag_s") > H.MAX_LAG_S) | (F.col("errno") != 0)
    return v("fx_sample").withColumn("state", F.when(bad, "problem").otherwise("ok"))


STATES = """
with s as (select node, sample_id, ts, case when lag_s > 300 or errno <> 0 then 'problem' else 'ok' end as state from fx_sample),
p as (select *, lag(state, 1, 'ok') over (partition by node order by ts, sample_id) as before from s)
"""


@query("win02_transitions", STATES + "select node, sample_id, before, state from p where state <> before")
def _(v):
    return H.transitions(states(v)).select("node", "sample_id", "before", "state")


@query("win07_queue_trend", """
with p as (select node, sample_id, ts, queued, lag(queued) over (partition by node order by ts, sample_id) as before from fx_sample),
u as (select *, case when queued > before then 1 else 0 end as up from p),
c as (select *, sum(up) over (partition by node order by ts, sample_id rows unbounded preceding) as ups from u),
r as (select *, ups - coalesce(max(case when up = 0 then ups end) over (partition by node order by ts, sample_id rows unbounded preceding), 0) as streak from c)
select node, sample_id, cast(streak as bigint) as streak, case when streak >= 3 then 'growing' when queued < before then 'draining' else 'steady' end as trend from r""")
def _(v):
    return H.queue_trend(v("fx_sample"), 3).select("node", "sample_id", "streak", "trend")


@query("str03_watchdog_batch", """
select cast(floor(epoch(ts) / 300) as bigint) * 300 as start, node, count(*) as samples, max(lag_s) as max_lag, max(queued) as max_queued, max(case when errno <> 0 then 1 else 0 end) as any_error from fx_sample group by 1, 2""")
def _(v):
    return H.watchdog_windows(v("fx_sample").withColumn("ts", F.col("ts").cast("timestamp")))


_WANTED = "select distinct n.node, j.jail, d.day from (select distinct day from fx_jail_present) d, (values ('A'), ('B')) n(node), (values ('admin'), ('dovecot'), ('webmail'), ('sshd')) j(jail)"


@query("set03_missing", f"{_WANTED} except select node, jail, day from fx_jail_present")
def _(v):
    present = v("fx_jail_present").select("node", "jail", "day")
    nodes = F.explode(F.array(F.lit("A"), F.lit("B"))).alias("node")
    jails = F.explode(F.array(*[F.lit(j) for j in ("admin", "dovecot", "webmail", "sshd")]))
    days = present.select("day").distinct()
    wanted = days.select("day", nodes).select("node", jails.alias("jail"), "day")
    return H.missing(wanted, present)


@query("set04_forbidden_present", """
select host_no, port from fx_host where port in (110, 995, 3306, 11334, 12345) and reachable_public = 1""")
def _(v):
    hosts = v("fx_host")
    present = hosts.where("reachable_public = 1").select("host_no", "port")
    return H.forbidden_present(H.per_host(hosts, H.CLOSED_PORTS, "port"), present)


@query("set05_distinct_sorted", "select distinct lower(rcpt) as address from fx_rcpt order by 1")
def _(v):
    return H.distinct_sorted(v("fx_rcpt").select(S.norm_addr("rcpt").alias("address")), "address")
