"""Posture queries: DNS, certificates, signing keys, delivery policy, failover."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailfleet.catalog.registry import as_of, query
from mailfleet.functions import scalars as S
from mailfleet.operators import posture as P
from mailfleet.sources.records import cert_names, dns_from_api

_NORM = "rtrim(lower(target), '.')"
POLICY = P.DnsPolicy(("sg1.example.com", "us1.example.com"), ("203.0.113.10", "198.51.100.20"))


@query("src08_dns_from_api", """
with p as (select zone, unnest(from_json(json_extract(payload, '$.data'), '[{"id":"BIGINT","type":"VARCHAR","name":"VARCHAR","target":"VARCHAR","ttl_sec":"INTEGER"}]')) as r from fx_api)
select zone, r.id as id, r.type as type, case when r.name = '' then '@' else r.name end as name, r.target as target, r.ttl_sec as ttl from p""")
def _(v):
    return dns_from_api(v("fx_api"), keep=("zone",))


@query("src09_cert_names", "select distinct serial, lineage, trim(unnest(string_split(sans, ','))) as san from fx_cert")
def _(v):
    return cert_names(v("fx_cert"), keep=("serial", "lineage"))


@query("udf03_table_rows", """
select 'san' as kind, lineage as key, san as value from (select distinct lineage, trim(unnest(string_split(sans, ','))) as san from fx_cert)
union all select 'spf', zone, m from (select zone, unnest(string_split(target, ' ')) as m from fx_dns where type = 'TXT' and target like 'v=spf1%') where m <> 'v=spf1'
union all select 'alias', address, trim(unnest(string_split(goto_list, ','))) from fx_alias""")
def _(v):
    from mailfleet.operators.directory import alias_rows

    def rows(df, kind, key, value):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.col(value).alias("value"))

    aliases = alias_rows(v("fx_alias").withColumnRenamed("goto_list", "goto"))
    return (
        rows(P.san_rows(v("fx_cert")), "san", "lineage", "san")
        .unionByName(rows(P.spf_rows(v("fx_dns")), "spf", "zone", "mechanism"))
        .unionByName(rows(aliases, "alias", "address", "target"))
    )


@query("udf03_sql_functions", """
select 'san' as kind, lineage as key, i as position, list_extract(l, i) as value from (select lineage, l, unnest(range(1, len(l) + 1)) as i from (select distinct lineage, list_filter([trim(x) for x in string_split(sans, ',')], lambda x: x <> '') as l from fx_cert))
union all select 'alias', address, i, list_extract(l, i) from (select address, l, unnest(range(1, len(l) + 1)) as i from (select address, list_filter([trim(x) for x in string_split(goto_list, ',')], lambda x: x <> '') as l from fx_alias))
union all select 'spf', zone, i - 1, list_extract(l, i) from (select zone, l, unnest(range(2, len(l) + 1)) as i from (select zone, string_split(target, ' ') as l from fx_dns where type = 'TXT' and target like 'v=spf1%'))""")
def _(v):
    from mailfleet.functions.tables import register

    register(v.spark)
    return v.sql("""
        select 'san' as kind, c.lineage as key, t.position, t.value from (select distinct lineage, sans from fx_cert) c, lateral list_items(c.sans) t
        union all select 'alias', a.address, t.position, t.value from fx_alias a, lateral list_items(a.goto_list) t
        union all select 'spf', d.zone, t.position, t.mechanism from fx_dns d, lateral spf_mechanisms(d.target) t where d.type = 'TXT'""")


_EXPECTED = """
z as (select distinct zone from fx_dns),
e as (select zone, name, type, target from z, (values ('@', 'MX', 'sg1.example.com'), ('@', 'MX', 'us1.example.com'), ('mail', 'A', '203.0.113.10'), ('mail', 'A', '198.51.100.20'), ('webmail', 'A', '203.0.113.10'), ('webmail', 'A', '198.51.100.20'), ('autoconfig', 'A', '203.0.113.10'), ('autoconfig', 'A', '198.51.100.20'), ('autodiscover', 'A', '203.0.113.10'), ('autodiscover', 'A', '198.51.100.20'), ('admin', 'A', '203.0.113.10')) x(name, type, target)),
a as (select distinct zone, name, type, rtrim(lower(target), '.') as target from fx_dns where type in ('MX', 'A'))
"""


@query("join14_dns_diff", f"""
with {_EXPECTED}
select *, 'missing' as state from (select zone, name, type, target from e except select zone, name, type, target from a)
union all select *, 'unexpected' from (select zone, name, type, target from a except select zone, name, type, target from e)""")
def _(v):
    actual = v("fx_dns").where(F.col("type").isin("MX", "A"))
    return P.dns_diff(P.expected_records(v("fx_dns").select("zone").distinct(), POLICY), actual)


@query("join15_fcrdns", """
select p.ip, p.expected, p.ptr, case when p.ptr is null then 'none' when p.ptr <> p.expected then 'mismatch' when f.address is null then 'forward-mismatch' else 'ok' end as state
from fx_ptr p left join fx_forward f on f.name = p.ptr and f.address = p.ip""")
def _(v):
    return P.fcrdns(v("fx_ptr"), v("fx_forward"))


@query("join16_dkim_match", """
select zone, selector, case when published is null then 'missing' when published = local_key then 'match' when starts_with(local_key, published) then 'truncated' else 'mismatch' end as state from fx_dkim""")
def _(v):
    local = v("fx_dkim").select("zone", "selector", "local_key")
    return P.dkim_match(local, v("fx_dkim_txt"))


_COVER = "with c as (select san, min(lineage) as lineage from (select lineage, trim(unnest(string_split(sans, ','))) as san from fx_cert) group by san), h as (select host_no, rtrim(lower(host), '.') as host from fx_sni_host)"


@query("join17_sni_map", _COVER + " select h.host_no, c.lineage from h left join c on c.san = h.host")
def _(v):
    names = cert_names(v("fx_cert"))
    return P.sni_map(v("fx_sni_host"), names).select("host_no", "lineage")


@query("join17_uncovered_hosts", _COVER + " select h.host_no from h where h.host not in (select san from c)")
def _(v):
    return P.uncovered_hosts(v("fx_sni_host"), cert_names(v("fx_cert"))).select("host_no")


@query("rul01_dns_posture", """
with r as (select zone, lower(name) as name, type, prio, rtrim(lower(target), '.') as target, ttl from fx_dns_more),
cn as (select distinct case when name = '@' then zone else name || '.' || zone end as host from r where type = 'CNAME'),
g as (select zone, count(*) filter (type = 'MX' and target = 'sg1.example.com') as a, count(*) filter (type = 'MX' and target = 'us1.example.com') as b, min(prio) filter (type = 'MX') as lo, max(prio) filter (type = 'MX') as hi,
 count(*) filter (type = 'MX' and regexp_matches(target, '^[0-9.]+$')) as ip, count(*) filter (type = 'MX' and target in (select host from cn)) as cname, count(*) filter (type = 'A' and name = 'admin') as adm,
 max(ttl) filter (type = 'A' and name in ('mail', 'webmail', 'autoconfig', 'autodiscover', 'admin')) as t, count(*) filter (type = 'A' and name = 'sg1') as s, count(*) filter (type = 'A' and name = 'us1') as u from r group by zone),
sv as (select g.zone, x.svc from g, (values ('mail'), ('webmail'), ('autoconfig'), ('autodiscover')) x(svc)),
ad as (select zone, name, count(distinct target) as addresses from r where type = 'A' and target in ('203.0.113.10', '198.51.100.20') group by all)
select zone, 'mx does not list both nodes' as finding from g where a = 0 or b = 0 union all select zone, 'mx priorities differ' from g where lo < hi union all select zone, 'mx target is an address' from g where ip > 0
union all select zone, 'mx target is an alias name' from g where cname > 0 union all select zone, 'admin name needs exactly one address' from g where adm <> 1 union all select zone, 'ttl of a failover name too long' from g where t > 300
union all select zone, 'node name sg1 has several addresses' from g where s > 1 union all select zone, 'node name us1 has several addresses' from g where u > 1
union all select zone, 'node name sg1 has no address' from g where zone = 'example.com' and s = 0 union all select zone, 'node name us1 has no address' from g where zone = 'example.com' and u = 0
union all select sv.zone, 'service name ' || svc || ' lacks a node address' from sv left join ad on ad.zone = sv.zone and ad.name = svc where coalesce(addresses, 0) < 2""")
def _(v):
    return P.dns_posture(v("fx_dns_more"), POLICY)


@query("rul02_policy_records", """
with z as (select distinct zone, cast(regexp_extract(zone, '[0-9]+') as int) as n from fx_policy),
dm as (select zone, regexp_extract(target, 'p=([a-z]+)', 1) as stage from fx_policy where name = '_dmarc')
select z.zone, 'no delivery policy' as finding from z where zone not in (select zone from dm) union all select zone, 'delivery policy only observes' from dm where stage = 'none'
union all select zone, 'no transport policy' from z where n % 6 = 1 union all select zone, 'no transport reporting' from z where n % 8 = 3 union all select zone, 'no issuer record' from z where n % 10 = 5
union all select zone, 'foreign issuer allowed' from z where n % 10 <> 5 and n % 9 = 4 union all select zone, 'pop3 not refused' from z where n % 4 = 1 union all select zone, 'service record _imaps._tcp is wrong' from z where n % 7 = 6
union all select distinct f.zone, 'transport policy omits ' || rtrim(f.target, '.') from fx_policy f join z on z.zone = f.zone where f.type = 'MX' and n % 6 <> 1 and not (rtrim(f.target, '.') = 'sg1.example.com' or (rtrim(f.target, '.') = 'us1.example.com' and n % 5 <> 2))""")
def _(v):
    return P.policy_records(v("fx_policy"))


@query("rul03_txt_segments", """
with t as (select zone, selector, txt, case when contains(txt, '"') then regexp_extract_all(txt, '"([^"]*)"', 1) else [txt] end as parts, regexp_replace(regexp_replace(txt, '["\\s]', '', 'g'), '^.*p=', '') as k from fx_dkim_txt where txt is not null)
select zone, selector, 'string too long' as finding from t where len(list_filter(parts, lambda s: length(s) > 255)) > 0 union all select zone, selector, 'key too short' from t where length(k) < 384""")
def _(v):
    return P.txt_segments(v("fx_dkim_txt"), min_key=384)


@query("rul04_ipv6_complete", """
select zone, count(*) filter (type = 'AAAA') as aaaa from fx_dns group by zone having count(*) filter (type = 'AAAA') > 0 and count(*) filter (type = 'TXT' and target like 'v=spf1%' and target like '%ip6:%') = 0""")
def _(v):
    return P.ipv6_complete(v("fx_dns"))


@query("rul05_cert_posture", """
with c as (select lineage, serial, cast(trunc((days_left * 86400 - 43200) / 86400.0) as bigint) as days, cert_hash, key_hash from fx_cert)
select lineage, serial, days, case when days < 0 then 'expired' when days < 10 then 'fail' when days < 21 then 'warn' else 'ok' end as status, case when cert_hash = key_hash then 1 else 0 end as key_matches from c""")
def _(v):
    end = F.timestamp_seconds(S.epoch_s(as_of()) + F.col("days_left") * 86400 - 43200)
    return P.cert_posture(v("fx_cert").withColumn("not_after", end), as_of())


@query("agg09_spf_audit", """
with z as (select distinct zone from fx_dns),
s as (select zone, target, regexp_extract(target, '([+?~-]?)all$', 1) as q from fx_dns where type = 'TXT' and name = '@' and target like 'v=spf1%' and zone not like '%7.example.com'),
g as (select zone, count(*) as records, max(case when contains(target, 'ip4:203.0.113.10') then 1 else 0 end) + max(case when contains(target, 'ip4:198.51.100.20') then 1 else 0 end) as nodes_authorised,
 max(case when contains(target, 'include:') then 1 else 0 end) as lookups, min(q) as ending from s group by zone),
a as (select z.zone, coalesce(records, 0) as records, coalesce(nodes_authorised, 0) as nodes_authorised, coalesce(lookups, 0) as lookups, ending from z left join g using (zone))
select *, case when records <> 1 or nodes_authorised < 2 or lookups > 10 then 'error' when ending <> '-' then 'warn' else 'ok' end as status from a""")
def _(v):
    # Some zones have no such record at all.
    dns = v("fx_dns")
    return P.spf_audit(dns.where(~(
        dns["target"].startswith("v=spf1") & dns["zone"].endswith("7.example.com")
    )), POLICY)


@query("agg11_selector_coverage", """
select domain, count(distinct case when pass = 1 then selector end) as selectors, case when count(distinct case when pass = 1 and selector in ('sg', 'us') then selector end) = 2 then 1 else 0 end as may_tighten from fx_report group by domain""")
def _(v):
    return P.selector_coverage(v("fx_report"), ["sg", "us"])


@query("agg11_merged_distinct", """
select domain, count(distinct user_id) as users, 1 as within_error from fx_report where cast(ts as date) between date '2024-01-05' and date '2024-01-20' group by domain""")
def _(v):
    first, last = (F.lit(d).cast("date") for d in ("2024-01-05", "2024-01-20"))
    rows = v("fx_report")
    sketches = P.distinct_sketches(rows, ["domain"], "user_id", "ts")
    merged = P.merged_distinct(sketches, ["domain"], first, last)
    exact = rows.where(F.to_date("ts").between(first, last)).groupBy("domain").agg(
        F.countDistinct("user_id").alias("users"))
    off = F.abs(F.col("estimate") - F.col("users"))
    # Small counts are exact up to rounding.
    fits = off <= F.greatest(F.lit(1.0), F.col("users") * P.sketch_error())
    return merged.join(exact, "domain").select("domain", "users", fits.cast("int").alias("within_error"))


@query("agg12_dmarc_stage", """
with p as (select domain, selector, count(*) as n, sum(pass) as ok, min(ts) as lo, max(ts) as hi from fx_report group by 1, 2),
d as (select domain, cast(floor((max(floor(epoch(hi))) - min(floor(epoch(lo)))) / 86400) as bigint) as days, count(*) filter (selector in ('sg', 'us')) as selectors, min(case when ok * 100 >= n * 90 then 1 else 0 end) as clean from p group by domain)
select *, case when clean = 0 or selectors < 2 or days < 14 then 'none' when days < 28 then 'quarantine' else 'reject' end as stage, case when clean = 1 and selectors = 2 and days >= 14 and days < 28 then 25 else 100 end as pct from d""")
def _(v):
    return P.dmarc_stage(v("fx_report"), ["sg", "us"], min_pass_pct=90)


@query("win03_install_decisions", """
with recursive o as (select lineage, serial, days_left as not_after, row_number() over (partition by lineage order by seq) as i from fx_cert),
f as (
 select lineage, serial, not_after, i, cast(null as bigint) as installed, 'install' as decision, serial as cur_serial, not_after as cur_end from o where i = 1
 union all
 select o.lineage, o.serial, o.not_after, o.i, f.cur_serial, case when o.serial = f.cur_serial then 'skip' when o.not_after < f.cur_end then 'refuse' else 'install' end,
  case when o.serial = f.cur_serial or o.not_after < f.cur_end then f.cur_serial else o.serial end, case when o.serial = f.cur_serial or o.not_after < f.cur_end then f.cur_end else o.not_after end
 from f join o on o.lineage = f.lineage and o.i = f.i + 1)
select lineage, serial, installed, decision from f""")
def _(v):
    offers = v("fx_cert").withColumn("not_after", F.col("days_left"))
    rows = P.install_decisions(offers, chunk_size=500)
    return rows.select("lineage", "serial", "installed", "decision")


@query("win03_guarded_installs", """
with recursive b as (select coalesce(f.bundle, m.bundle) as bundle, min(case when f.name is not null and m.name is not null and sha256(f.content) = sha256(m.content) then 1 else 0 end) as fine
 from fx_bundle_file f full join fx_bundle_src m on f.bundle = m.bundle and f.name = m.name group by 1),
o as (select lineage, serial, days_left as not_after, coalesce(b.fine, 0) as fine, case when cert_hash = key_hash then 1 else 0 end as fits, row_number() over (partition by lineage order by seq) as i from fx_cert left join b on b.bundle = serial),
f as (
 select lineage, i, serial, cast(null as bigint) as installed, case when fine = 0 or fits = 0 then 'refuse' else 'install' end as decision, case when fine = 0 then 'bundle_ok' when fits = 0 then 'key_ok' end as reason,
  case when fine = 1 and fits = 1 then serial end as cur_serial, case when fine = 1 and fits = 1 then not_after end as cur_end from o where i = 1
 union all
 select o.lineage, o.i, o.serial, f.cur_serial, case when fine = 0 or fits = 0 then 'refuse' when o.serial = f.cur_serial then 'skip' when o.not_after < f.cur_end then 'refuse' else 'install' end,
  case when fine = 0 then 'bundle_ok' when fits = 0 then 'key_ok' when o.serial <> f.cur_serial and o.not_after < f.cur_end then 'expiry' end,
  case when fine = 0 or fits = 0 or o.serial = f.cur_serial or o.not_after < f.cur_end then f.cur_serial else o.serial end, case when fine = 0 or fits = 0 or o.serial = f.cur_serial or o.not_after < f.cur_end then f.cur_end else o.not_after end
 from f join o on o.lineage = f.lineage and o.i = f.i + 1)
select lineage, serial, installed, decision, reason from f""")
def _(v):
    manifest = v("fx_bundle_src").select("bundle", "name", F.sha2("content", 256).alias("sha256"))
    offers = v("fx_cert").withColumn("not_after", F.col("days_left")).withColumn("bundle", F.col("serial"))
    guarded = P.guarded_offers(offers, v("fx_bundle_file"), manifest)
    rows = P.install_decisions(guarded, chunk_size=500, guards=("bundle_ok", "key_ok"))
    return rows.select("lineage", "serial", "installed", "decision", "reason")


@query("win12_rotation_overlap", """
with h as (select *, lead(valid_from) over (partition by zone, node order by valid_from) as next_live from fx_key_history)
select zone, node, selector, cast(epoch(removed_at) - epoch(next_live) as bigint) as overlap_s from h where epoch(removed_at) - epoch(next_live) < greatest(604800, ttl)""")
def _(v):
    return P.rotation_overlap(v("fx_key_history"))


@query("rul09_failover_plan", """
with p as (select zone, case when tunnel_ok = 0 and public_ok = 0 then 'promote' else 'refuse' end as verdict from fx_probe),
c as (select zone, name, target, case when name in ('mail', 'webmail') and target = '198.51.100.20' then 'delete' when name = 'admin' and target <> '203.0.113.10' then 'repoint' end as action from fx_dns where type = 'A')
select p.zone, p.verdict, coalesce(c.action, 'none') as action, c.name, c.target as old_target, case when c.action = 'repoint' then '203.0.113.10' end as new_target
from p left join c on c.zone = p.zone and p.verdict = 'promote' and c.action is not null""")
def _(v):
    return P.failover_plan(v("fx_probe"), v("fx_dns"), POLICY)


@query("rul09_restore_plan", """
select zone, h as name, t as target, 'add' as action, 300 as ttl from (select distinct zone from fx_dns), (values ('mail'), ('webmail')) y(h), (values ('203.0.113.10'), ('198.51.100.20')) x(t)
where (zone, h, t) not in (select zone, name, target from fx_dns where type = 'A')""")
def _(v):
    return P.restore_plan(v("fx_dns"), POLICY)


@query("scl13_tag_map", """
select zone, regexp_extract(target, 'p=([a-z]+)', 1) as p, 'r' as adkim, 'DMARC1' as v from fx_dns where name = '_dmarc'""")
def _(v):
    rows = v("fx_dns").where("name = '_dmarc'")
    return rows.select("zone", *[S.tag("target", t).alias(t) for t in ("p", "adkim", "v")])
