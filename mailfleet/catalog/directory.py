"""Directory queries: lookups, resolution, senders, administration."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailfleet.catalog.registry import AS_OF, as_of, directory, query
from mailfleet.functions import scalars as S
from mailfleet.operators import directory as D
from mailfleet.operators.lists import expand_aliases
from mailfleet.plans.session import shared_folder
from mailfleet.sources.schema import KEYS, conform, load_mail_schema

# Recipients with their parts, as every oracle here starts.
R = """
with r as (
 select rcpt_id, rcpt, sasl_login, lower(trim(rcpt)) as addr,
  split_part(split_part(lower(trim(rcpt)), '@', 1), '+', 1) as u, split_part(lower(trim(rcpt)), '@', 2) as d,
  split_part(split_part(lower(trim(rcpt)), '@', 1), '+', 1) || '@' || split_part(lower(trim(rcpt)), '@', 2) as k from fx_rcpt),
ld as (select domain from fx_domain where active = 1 and backupmx = 0 and domain <> 'ALL'),
ad as (select alias_domain, target_domain from fx_alias_domain where active = 1),
al as (select address, goto_list as goto from fx_alias where active = 1),
mb as (select * from fx_mailbox where active = 1)
"""


@query("src01_load_mail_schema", """
select username, local_part, domain, maildir, quota, active, epoch_us(password_expiry) as password_expiry_us, cast(null as varchar) as phone from fx_mailbox
""")
def _(v):
    path = shared_folder(v.spark, "schema")
    v("fx_mailbox").write.parquet(f"{path}/mailbox")
    box = load_mail_schema(v.spark, path, ["mailbox"])["mailbox"]
    return box.select(
        "username", "local_part", "domain", "maildir", "quota", "active",
        S.epoch_us("password_expiry").alias("password_expiry_us"), "phone",
    )


# Every table of the schema: how its rows come about here, and its key.
ALL_TABLES = {
    "admin": ("select concat(' Admin', cast(s_suppkey as string), '@D1.example.com') as username, 1 as active from supplier", "username"),
    "domain": ("select * from fx_domain", "domain"),
    "domain_admins": ("select * from fx_grant", "username, domain"),
    "alias": ("select address, goto_list as goto, active from fx_alias", "address"),
    "alias_domain": ("select upper(alias_domain) as alias_domain, target_domain, active from fx_alias_domain", "alias_domain"),
    "mailbox": ("select username, quota, active from fx_mailbox", "username"),
    "log": ("select id, data, created as \"timestamp\" from fx_log_a", "id"),
    "vacation": ("select * from fx_vacation", "email"),
    "vacation_notification": ("select * from fx_notified", "on_vacation, notified"),
    "quota": ("select username, folder as path, cast(sum(vsize) as bigint) as current from fx_usage group by username, folder", "username, path"),
    "quota2": ("select username, cast(sum(vsize) as bigint) as bytes, cast(count(*) as int) as messages from fx_usage group by username", "username"),
    "fetchmail": ("select cast(c_custkey as int) as id, 'pop' as src_auth, 1 as active from customer", "id"),
    "tls_policy": ("select * from fx_tls", "domain"),
    "config": ("select cast(p_partkey as int) as id, p_name as name from part", "id"),
}


def _counted(name: str) -> str:
    sql, key = ALL_TABLES[name]
    parts = [c if c == "path" else f"lower(trim(cast({c} as varchar)))" for c in key.split(", ")]
    return (f"select '{name}' as \"table\", count(*) as rows, count(distinct ({' || chr(10) || '.join(parts)})) as keys, "
            f"{len(parts)} as key_columns from ({sql})")


@query("src01_load_all_tables", " union all ".join(_counted(name) for name in ALL_TABLES))
def _(v):
    path = shared_folder(v.spark, "schema")
    for name, (sql, _key) in ALL_TABLES.items():
        v.sql(sql.replace('"', "`")).write.parquet(f"{path}/{name}")
    out = None
    for name, df in load_mail_schema(v.spark, path).items():
        key = KEYS[name]
        one = df.agg(
            F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
            F.count_distinct(*key).alias("keys"), F.lit(len(key)).alias("key_columns"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("fil01_local_domains", R + "select rcpt_id, d as domain from r where d in (select domain from ld)")
def _(v):
    keys = v("fx_rcpt").select("rcpt_id", S.addr_domain("rcpt").alias("domain"))
    return D.domain_lookup(keys, D.local_domains(directory(v)["domain"]))


@query("fil02_alias_domains", R + "select rcpt_id, d as domain from r where d in (select alias_domain from ad)")
def _(v):
    keys = v("fx_rcpt").select("rcpt_id", S.addr_domain("rcpt").alias("domain"))
    return D.domain_lookup(keys, D.alias_domains(directory(v)["alias_domain"]))


@query("fil03_mailbox_lookup", R + "select rcpt_id, maildir from r left join mb on mb.username = r.addr")
def _(v):
    keys = v("fx_rcpt").select("rcpt_id", "rcpt")
    return D.mailbox_lookup(keys, directory(v)["mailbox"]).select("rcpt_id", "maildir")


@query("fil04_mailbox_limit", R + "select rcpt_id, quota from r join mb on mb.username = r.addr where quota > 0")
def _(v):
    keys = v("fx_rcpt").select("rcpt_id", "rcpt")
    return D.mailbox_limit(keys, directory(v)["mailbox"]).select("rcpt_id", "quota")


@query("fil05_tls_policy", R + """
select rcpt_id, d as domain, coalesce(trim(t.policy || ' ' || t.params), 'may') as tls
from r left join fx_tls t on t.domain = r.d and t.active = 1""")
def _(v):
    dest = v("fx_rcpt").select("rcpt_id", S.addr_domain("rcpt").alias("domain"))
    return D.tls_policy(dest, conform(v("fx_tls"), "tls_policy"))


_STORE = """'/var/vmail/' || m.domain || '/' || m.local_part as home,
 'maildir:/var/vmail/' || m.domain || '/' || m.local_part || '/Maildir:INDEX=/var/vmail-index/' || m.domain || '/' || m.local_part
 || '/index:CONTROL=/var/vmail-index/' || m.domain || '/' || m.local_part || '/control' as mail"""


@query("fil06_auth_lookup", R + f"""
select rcpt_id, m.username as user, '*:bytes=' || cast(m.quota as varchar) as quota_rule, {_STORE}
from r join mb m on m.username = r.addr
where m.password_expiry = timestamp '2000-01-01 00:00:00' or m.password_expiry > timestamp '{AS_OF}'""")
def _(v):
    keys = v("fx_rcpt").select("rcpt_id", "rcpt")
    found = D.auth_lookup(keys, directory(v)["mailbox"], as_of())
    return found.select("rcpt_id", "user", "quota_rule", "home", "mail")


@query("fil07_user_lookup", R + f"""
select rcpt_id, m.username as user, '*:bytes=' || cast(m.quota as varchar) as quota_rule, {_STORE}, 5000 as uid, 5000 as gid
from r join mb m on m.username = r.addr""")
def _(v):
    keys = v("fx_rcpt").select("rcpt_id", "rcpt")
    found = D.user_lookup(keys, directory(v)["mailbox"])
    return found.select("rcpt_id", "user", "quota_rule", "home", "mail", "uid", "gid")


@query("fil08_iterate_users", "select username as user from fx_mailbox where active = 1")
def _(v):
    return D.iterate_users(directory(v)["mailbox"])


@query("fil09_vacation_active", f"""
select email, interval_time from fx_vacation
where active = 1 and timestamp '{AS_OF}' between activefrom and activeuntil""")
def _(v):
    vacation = conform(v("fx_vacation"), "vacation")
    return D.vacation_active(vacation, as_of()).select("email", "interval_time")


@query("fil10_valid_tokens", f"""
select username, token, epoch_us(token_validity) as token_validity_us from fx_mailbox
where token <> '' and token_validity >= timestamp '{AS_OF}'""")
def _(v):
    rows = D.valid_tokens(directory(v)["mailbox"], as_of())
    return rows.select("username", "token", S.epoch_us("token_validity").alias("token_validity_us"))


@query("join01_alias_lookup", R + """
select rcpt_id, coalesce(a.goto, c.goto) as goto, case when a.goto is not null then 'address' else 'domain' end as matched
from r left join al a on a.address = r.k left join al c on c.address = '@' || r.d
where coalesce(a.goto, c.goto) is not null""")
def _(v):
    keys = v("fx_rcpt").select("rcpt_id", "rcpt")
    return D.alias_lookup(keys, directory(v)["alias"]).select("rcpt_id", "goto", "matched")


@query("join02_alias_domain_lookup", R + """
select rcpt_id, target_domain, goto from r join ad on ad.alias_domain = r.d join al on al.address = r.u || '@' || ad.target_domain""")
def _(v):
    t, keys = directory(v), v("fx_rcpt").select("rcpt_id", "rcpt")
    rows = D.alias_domain_lookup(keys, t["alias"], t["alias_domain"])
    return rows.select("rcpt_id", "target_domain", "goto")


@query("join03_alias_domain_catchall", R + """
select rcpt_id, target_domain, goto from r join ad on ad.alias_domain = r.d join al on al.address = '@' || ad.target_domain""")
def _(v):
    t, keys = directory(v), v("fx_rcpt").select("rcpt_id", "rcpt")
    rows = D.alias_domain_catchall(keys, t["alias"], t["alias_domain"])
    return rows.select("rcpt_id", "target_domain", "goto")


@query("join04_alias_domain_mailbox", R + """
select rcpt_id, target_domain, maildir from r join ad on ad.alias_domain = r.d join mb on mb.username = r.u || '@' || ad.target_domain""")
def _(v):
    t, keys = directory(v), v("fx_rcpt").select("rcpt_id", "rcpt")
    rows = D.alias_domain_mailbox(keys, t["mailbox"], t["alias_domain"])
    return rows.select("rcpt_id", "target_domain", "maildir")


def _resolved(order: list[str]) -> str:
    value = {
        "alias": "a.goto", "ad_alias": "b.goto", "ad_catchall": "c.goto", "catchall": "e.goto",
        "mailbox": "m.maildir", "ad_mailbox": "n.maildir",
    }
    route = " ".join(f"when {value[name]} is not null then '{name}'" for name in order)
    target = ", ".join(value[name] for name in order)
    return R + f""",
x as (
 select r.rcpt_id, r.k, case when ld.domain is null and ad.target_domain is null then 'relay_denied' {route} else 'unlisted' end as route,
  case when ld.domain is null and ad.target_domain is null then null else coalesce({target}) end as target
 from r left join ld on ld.domain = r.d left join ad on ad.alias_domain = r.d
 left join al a on a.address = r.k left join al b on b.address = r.u || '@' || ad.target_domain
 left join al c on c.address = '@' || ad.target_domain left join al e on e.address = '@' || r.d
 left join mb m on m.username = r.k left join mb n on n.username = r.u || '@' || ad.target_domain)
"""


_STRICT = _resolved(["alias", "ad_alias", "ad_catchall", "catchall", "mailbox", "ad_mailbox"])
_BOXES = _resolved(["alias", "ad_alias", "mailbox", "ad_mailbox", "ad_catchall", "catchall"])


@query("join05_resolve_recipients", _STRICT + "select rcpt_id, k as key, route, target from x")
def _(v):
    rows = D.resolve_recipients(v("fx_rcpt"), directory(v))
    return rows.select("rcpt_id", "key", "route", "target")


@query("join05_resolve_mailbox_first", _BOXES + "select rcpt_id, k as key, route, target from x")
def _(v):
    rows = D.resolve_recipients(v("fx_rcpt"), directory(v), mode="mailbox_first")
    return rows.select("rcpt_id", "key", "route", "target")


@query("join05_route_counts", _STRICT + "select route, count(*) as recipients, count(distinct k) as addresses from x group by route")
def _(v):
    return D.route_counts(v("fx_rcpt"), directory(v))


@query("join06_expand_aliases", """
with recursive starts as (
 select distinct split_part(split_part(lower(rcpt), '@', 1), '+', 1) || '@' || split_part(lower(rcpt), '@', 2) as origin from fx_rcpt union select address from fx_alias_loop),
edges as (select address, trim(unnest(string_split(goto_list, ','))) as target from (
 select address, goto_list from fx_alias where active = 1 union all select address, goto_list from fx_alias_loop)),
walk as (
 select distinct s.origin, e.target as node from (select origin from starts union select address from edges) s join edges e on e.address = s.origin
 union select w.origin, e.target from walk w join edges e on e.address = w.node)
select origin, node as target, 'leaf' as kind from walk where origin in (select origin from starts) and node not in (select address from edges)
union all select origin, origin, 'leaf' from starts where origin not in (select address from edges)
union all select origin, node, 'cycle' from walk where origin in (select origin from starts) and node in (select origin from walk where node = origin)
""")
def _(v):
    loops = v("fx_alias_loop")
    starts = v("fx_rcpt").select(S.bare_addr("rcpt").alias("address")).union(loops.select("address"))
    alias = directory(v)["alias"].select("address", "goto", "active")
    more = loops.select("address", F.col("goto_list").alias("goto"), F.lit(1).alias("active"))
    return expand_aliases(starts, alias.union(more)).select("origin", "target", "kind")


_LOGINS = R + """,
own as (select username as address, username as login from mb union
 select address, trim(unnest(string_split(goto, ','))) from al)
"""


@query("join07_sender_authorised", _LOGINS + """
select rcpt_id, sasl_login from r where exists (select 1 from own where own.address = r.k and own.login = lower(r.sasl_login))""")
def _(v):
    t = directory(v)
    rows = D.sender_authorised(v("fx_rcpt"), t["mailbox"], t["alias"])
    return rows.select("rcpt_id", "sasl_login")


@query("join07_spoof_attempts", _LOGINS + """
select rcpt_id, sasl_login from r where not exists (select 1 from own where own.address = r.k and own.login = lower(r.sasl_login))""")
def _(v):
    t = directory(v)
    rows = D.sender_authorised(v("fx_rcpt"), t["mailbox"], t["alias"], authorised=False)
    return rows.select("rcpt_id", "sasl_login")


@query("join08_unlisted_recipients", _STRICT + "select rcpt_id, k as key from x where route = 'unlisted'")
def _(v):
    return D.unlisted_recipients(v("fx_rcpt"), directory(v)).select("rcpt_id", "key")


@query("join19_admin_scope", """
select a.id, a.username, a.domain, case when exists (select 1 from fx_grant g where g.username = a.username and g.domain = 'ALL' and g.active = 1) then 'all'
 when exists (select 1 from fx_grant g where g.username = a.username and g.domain = a.domain and g.active = 1) then 'domain' else 'none' end as scope
from fx_audit a""")
def _(v):
    requests = v("fx_audit").select("id", "username", "domain")
    return D.admin_scope(requests, conform(v("fx_grant"), "domain_admins"))


@query("join19_admin_domains", """
with g as (select concat('admin', cast(c_custkey % 50 as string)) as username, case when c_custkey % 50 = 7 then 'ALL' else concat('d', cast(c_custkey as string), '.example.com') end as domain from customer),
d as (select concat('d', cast(c_custkey as string), '.example.com') as domain from customer where c_custkey % 10 <> 0)
select username, max(case when domain = 'ALL' then 1 else 0 end) as superadmin,
 case when max(case when domain = 'ALL' then 1 else 0 end) = 1 then (select count(*) from d) else count(distinct case when domain in (select domain from d) then domain end) end as domains
from g group by username""")
def _(v):
    grants = v.sql(
        "select concat('admin', cast(c_custkey % 50 as string)) as username, case when c_custkey "
        "% 50 = 7 then 'ALL' else concat('d', cast(c_custkey as string), '.example.com') end as "
        "domain, 1 as active from customer"
    )
    domains = v.sql(
        "select concat('d', cast(c_custkey as string), '.example.com') as domain from customer "
        "where c_custkey % 10 <> 0"
    )
    return D.admin_domains(conform(grants, "domain_admins"), conform(domains, "domain"))


@query("agg01_domain_usage", """
select d.domain, d.mailboxes as max_mailboxes, d.aliases as max_aliases, coalesce(m.n, 0) as n_mailboxes, coalesce(a.n, 0) as n_aliases,
 case when d.mailboxes > 0 and coalesce(m.n, 0) > d.mailboxes then 1 else 0 end as over_mailboxes, case when d.aliases > 0 and coalesce(a.n, 0) > d.aliases then 1 else 0 end as over_aliases
from fx_domain d left join (select domain, count(*) as n from fx_mailbox group by 1) m on m.domain = d.domain
left join (select domain, count(*) as n from fx_alias group by 1) a on a.domain = d.domain where d.domain <> 'ALL'""")
def _(v):
    t = directory(v)
    return D.domain_usage(t["domain"], t["mailbox"], t["alias"])


@query("agg15_audit_summary", """
select domain, action, username, count(*) as entries, cast(grouping(domain, action, username) as int) as level from fx_audit group by rollup(domain, action, username)""")
def _(v):
    return D.audit_summary(v("fx_audit"))


_CANDS = R + """,
cands as (
 select r.k as key, 1 as prio, 'alias' as map, al.goto from r join al on al.address = r.k
 union select r.k, 2, 'ad_alias', al.goto from r join ad on ad.alias_domain = r.d join al on al.address = r.u || '@' || ad.target_domain
 union select r.k, 3, 'ad_catchall', al.goto from r join ad on ad.alias_domain = r.d join al on al.address = '@' || ad.target_domain
 union select r.k, 4, 'catchall', al.goto from r join al on al.address = '@' || r.d)
"""


@query("win01_first_hit", _CANDS + """
select key, prio, map, goto from (select *, row_number() over (partition by key order by prio) as rn from cands) where rn = 1""")
def _(v):
    return D.first_hit(D.candidates(v("fx_rcpt"), directory(v)), ["key"], "prio")


@query("set01_allowed_logins", _LOGINS + "select address, login from own")
def _(v):
    t = directory(v)
    return D.allowed_logins(t["mailbox"], t["alias"])


@query("rul10_address_rules", """
with names as (select domain from fx_mailbox union select domain from fx_alias union select concat('-bad', cast(c_custkey as string), '.x') from customer where c_custkey % 12 = 0),
boxes as (select username from fx_mailbox union all select concat('we ird', cast(c_custkey as string), '@d1.example.com') from customer where c_custkey % 14 = 0),
listed as (select username as a from boxes union select address from fx_alias),
roles as (select unnest(['abuse', 'hostmaster', 'postmaster', 'webmaster']) as role)
select 'invalid domain name' as finding, domain as subject from names where not regexp_matches(domain, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$')
union all select 'invalid login characters', username from boxes where not regexp_matches(username, '^[a-zA-Z0-9.\\-_@+]+$')
union all select 'role account missing', role || '@' || domain from roles, fx_domain where active = 1 and backupmx = 0 and domain <> 'ALL' and role || '@' || domain not in (select a from listed)
""")
def _(v):
    t = directory(v)
    odd = v.sql(
        "select concat('we ird', cast(c_custkey as string), '@d1.example.com') as username, "
        "'d1.example.com' as domain, 1 as active from customer where c_custkey % 14 = 0"
    )
    bad = v.sql(
        "select concat('x', cast(c_custkey as string), '@-bad') as address, concat('-bad', "
        "cast(c_custkey as string), '.x') as domain, 1 as active from customer where c_custkey % 12 = 0"
    )
    t["mailbox"] = t["mailbox"].unionByName(conform(odd, "mailbox"))
    t["alias"] = t["alias"].unionByName(conform(bad, "alias"))
    return D.address_rules(t)


_OCTETS = " || '.' || ".join(f"cast(({{0}} >> {n}) & 255 as varchar)" for n in (24, 16, 8, 0))


@query("scalar_networks", f"""
with c as (select c_custkey as k, 167772160 + c_custkey * 37 as n, cast(pow(2, 32 - (20 + c_custkey % 13)) as bigint) as size from customer),
r as (select *, n - n % size as lo, n - n % size + size - 1 as hi from c)
select k, {_OCTETS.format("lo")} as first_ip, {_OCTETS.format("hi")} as last_ip,
 array_to_string(range(k % 3 + 2, k % 7 + 2), ',') as missing, '{{"network":"' || {_OCTETS.format("n")} || '/' || cast(20 + k % 13 as varchar) || '","size":' || cast(size as varchar) || '}}' as report from r""")
def _(v):
    k = F.col("c_custkey")
    bits = F.lit(20) + k % 13
    cidr = F.concat_ws("/", S.long_to_ip(F.lit(167772160) + k * 37), bits.cast("string"))
    rows = v("customer").select(k.alias("k"), cidr.alias("network")).withColumn(
        "bounds", S.cidr_range("network")
    )
    lo, hi = F.col("bounds.lo"), F.col("bounds.hi")
    want, have = (F.sequence(F.lit(1), (F.col("k") % n + 1).cast("int")) for n in (7, 3))
    return rows.select(
        "k", S.long_to_ip(lo).alias("first_ip"), S.long_to_ip(hi).alias("last_ip"),
        F.array_join(S.list_diff(want, have).cast("array<string>"), ",").alias("missing"),
        S.report_json(network="network", size=hi - lo + 1).alias("report"),
    )


@query("scalar_suite", """
select rcpt_id, lower(trim(rcpt)) as addr, split_part(split_part(lower(rcpt), '@', 1), '+', 1) as local,
 case when contains(split_part(lower(rcpt), '@', 1), '+') then split_part(split_part(lower(rcpt), '@', 1), '+', 2) end as detail, split_part(lower(rcpt), '@', 2) as domain,
 rcpt_id % 2 as parity, rcpt_id * 1048576 as bytes, case when rcpt_id % 7 > 0 then floor((rcpt_id % 5) * 100.0 / (rcpt_id % 7)) end as percent, rcpt_id * 1000000 / 1000000 as ms,
 cast(trunc((epoch(ts) - epoch(timestamp '1998-06-01 12:00:00')) / 86400.0) as bigint) as days, cast(epoch(timestamp '1998-06-01 12:00:00') - epoch(ts) as bigint) as age,
 (rcpt_id // 65536 % 256) * 65536 + (rcpt_id // 256 % 256) * 256 + rcpt_id % 256 + 10 * 16777216 as ip_no, 1 as ip_private, case rcpt_id % 4 when 0 then 600 when 1 then 14400 when 2 then 604800 else 45 end * cast(1 as bigint) as dur,
 md5(rcpt) as md5, sha256(rcpt) as sha, 'reject' as tag_p, case when rcpt_id % 3 = 0 then '@' else 'mail' end as label
from fx_rcpt""")
def _(v):
    rows = v("fx_rcpt")
    ip = F.concat_ws(
        ".", F.lit("10"), F.floor(F.col("rcpt_id") / 65536) % 256,
        F.floor(F.col("rcpt_id") / 256) % 256, F.col("rcpt_id") % 256,
    )
    parts, at = S.split_addr("rcpt"), F.lit("1998-06-01 12:00:00").cast("timestamp")
    text = F.element_at(
        F.array(F.lit("10m"), F.lit("4h"), F.lit("7d"), F.lit("45")),
        (F.col("rcpt_id") % 4 + 1).cast("int"),
    )
    host = F.when(F.col("rcpt_id") % 3 == 0, "Example.com.").otherwise('"mail.example.com."')
    return rows.select(
        "rcpt_id", S.norm_addr("rcpt").alias("addr"), parts["local"].alias("local"),
        parts["detail"].alias("detail"), parts["domain"].alias("domain"),
        S.parity("rcpt_id").alias("parity"), S.mib_to_bytes("rcpt_id").alias("bytes"),
        S.pct(F.col("rcpt_id") % 5, F.col("rcpt_id") % 7).cast("double").alias("percent"),
        S.ns_to_ms(F.col("rcpt_id") * 1000000).alias("ms"),
        S.days_left("ts", at).alias("days"), S.age_s("ts", at).alias("age"),
        S.ip_to_long(ip).alias("ip_no"), S.is_private(ip).cast("int").alias("ip_private"),
        S.duration_s(text).alias("dur"), F.md5("rcpt").alias("md5"),
        S.content_sha256("rcpt").alias("sha"),
        S.tag(F.lit("v=DMARC1; p=reject; pct=25"), "p").alias("tag_p"),
        S.rel_label(host, F.lit("example.com")).alias("label"),
    )
