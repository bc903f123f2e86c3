"""Replica queries: differences, collisions, checksums, writing rules, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailfleet.catalog.registry import directory, query
from mailfleet.functions import scalars as S
from mailfleet.operators import replicas as R
from mailfleet.plans.session import shared_folder


@query("join09_replica_diff", """
select coalesce(a.natural_key, b.natural_key) as natural_key, case when b.natural_key is null then 'only_a' when a.natural_key is null then 'only_b'
 when a.data is not distinct from b.data and a.created is not distinct from b.created then 'equal' else 'changed' end as state
from fx_log_a a full join fx_log_b b on a.natural_key = b.natural_key""")
def _(v):
    tables = R.replicated_tables({"log": v("fx_log_a"), "quota2": v("fx_id")})
    return R.replica_diff(tables["log"], v("fx_log_b"), ["natural_key"], ignore=["id"])


@query("join09_replica_changes", """
select coalesce(a.natural_key, b.natural_key) as natural_key, case when b.natural_key is null then 'only_a' when a.natural_key is null then 'only_b' else 'changed' end as state
from fx_log_a a full join fx_log_b b on a.natural_key = b.natural_key
where a.natural_key is null or b.natural_key is null or a.data is distinct from b.data or a.created is distinct from b.created""")
def _(v):
    return R.replica_changes(v("fx_log_a"), v("fx_log_b"), ["natural_key"], ignore=["id"])


_COLLIDE = """
select a.id, a.natural_key, a.data as data_a, b.data as data_b, a.created as ca, b.created as cb
from fx_log_a a join fx_log_b b on a.natural_key = b.natural_key where a.data is distinct from b.data or a.created is distinct from b.created
"""


@query("join10_key_collisions", f"select natural_key, 'natural' as kind, data_a, data_b from ({_COLLIDE})")
def _(v):
    rows = R.key_collisions(
        v("fx_log_a"), v("fx_log_b"), ["natural_key"], "natural", ignore=["id"]
    )
    return rows.select(
        "natural_key", "kind", F.col("row_a.data").alias("data_a"),
        F.col("row_b.data").alias("data_b"),
    )


@query("join10_surrogate_collisions", """
select a.id, 'surrogate' as kind from fx_id a join (select id + case when id % 7 = 0 then 0 else 1000000000 end as id, node from fx_id where node = 'A') b on a.id = b.id where a.node = 'B' """)
def _(v):
    ids = v("fx_id").select("id", "node")
    a = ids.where("node = 'A'").withColumn(
        "id", F.col("id") + F.when(F.col("id") % 7 == 0, 0).otherwise(1000000000)
    )
    return R.key_collisions(a, ids.where("node = 'B'"), ["id"], "surrogate").select("id", "kind")


@query("join11_propose_resolution", f"""
select natural_key, case when ca <= cb then 'A' else 'B' end as keep, case when ca <= cb then 'B' else 'A' end as repair_on from ({_COLLIDE})""")
def _(v):
    found = R.key_collisions(
        v("fx_log_a"), v("fx_log_b"), ["natural_key"], "natural", ignore=["id"]
    )
    return R.propose_resolution(found).select("natural_key", "keep", "repair_on")


@query("join13_marker_lag", """
with seen as (select natural_key as marker, min(created + interval '1' second * cast(id % 41 as int)) as ts from fx_log_b group by 1)
select a.natural_key as marker, cast(epoch_ms(s.ts) - epoch_ms(a.created) as bigint) as lag_ms,
 case when s.ts is null then 'missing' when epoch_ms(s.ts) - epoch_ms(a.created) > 20000 then 'late' else 'ok' end as state
from fx_log_a a left join seen s on s.marker = a.natural_key""")
def _(v):
    sent = v.sql("select natural_key as marker, created as ts from fx_log_a")
    seen = v.sql(
        "select natural_key as marker, created + interval '1' second * cast(id % 41 as int) as ts "
        "from fx_log_b"
    )
    return R.marker_lag(sent, seen)


@query("agg02_table_counts", """
select 'log' as "table", 'A' as node, count(*) as rows from fx_log_a union all select 'log', 'B', count(*) from fx_log_b
union all select 'mailbox', 'A', count(*) from fx_mailbox union all select 'message', node, count(*) from fx_msg group by node""")
def _(v):
    def on(view: str, node: str):
        return v(view).select(F.lit(node).alias("node"))

    return R.table_counts({
        "log": on("fx_log_a", "A").union(on("fx_log_b", "B")), "mailbox": on("fx_mailbox", "A"),
        "message": v("fx_msg"),
    })


@query("agg03_ordered_checksum", """
with pair as (select 'A' as node, domain, username from fx_mailbox union all select 'B', domain, username from fx_mailbox where local_part <> 'u7')
select node, domain, count(*) as keys, md5(concat_ws(':', count(*), sum(cast('0x' || substr(md5(username), 1, 8) as bigint)), sum(cast('0x' || substr(md5(username), 9, 8) as bigint)), sum(cast('0x' || substr(md5(username), 17, 8) as bigint)), sum(cast('0x' || substr(md5(username), 25, 8) as bigint)))) as checksum from pair group by node, domain""")
def _(v):
    box = v("fx_mailbox")
    both = box.select(F.lit("A").alias("node"), "domain", "username").unionByName(
        box.where("local_part <> 'u7'").select(F.lit("B").alias("node"), "domain", "username")
    )
    return R.ordered_checksum(both, ["node", "domain"], "username")


@query("agg03_set_checksum", """
select count(*) as keys, md5(concat_ws(':', count(*), sum(cast('0x' || substr(md5(natural_key), 1, 8) as bigint)), sum(cast('0x' || substr(md5(natural_key), 9, 8) as bigint)), sum(cast('0x' || substr(md5(natural_key), 17, 8) as bigint)), sum(cast('0x' || substr(md5(natural_key), 25, 8) as bigint)))) as checksum from fx_log_a""")
def _(v):
    return R.set_checksum(v("fx_log_a"), "natural_key")


@query("agg05_parity_report", """
select node, id % 2 as parity, count(*) as ids, case when id % 2 <> (case node when 'A' then 1 else 0 end) then 1 else 0 end as violation from fx_id group by 1, 2, 4""")
def _(v):
    return R.parity_report(v("fx_id"), {"A": 1, "B": 2})


@query("snk01_insert_if_absent", """
select natural_key, data from fx_log_a union all select natural_key, data from fx_log_b where natural_key not in (select natural_key from fx_log_a)""")
def _(v):
    cols = ["natural_key", "data"]
    have, new = v("fx_log_a").select(cols), v("fx_log_b").select(cols)
    path = shared_folder(v.spark, "insert")
    have.write.parquet(path)
    for _run in range(2):  # the second run adds nothing
        table = v.spark.read.parquet(path)
        R.insert_if_absent(new, table, ["natural_key"]).write.mode("append").parquet(path)
    return v.spark.read.parquet(path)


@query("snk02_changed_only", """
select a.natural_key, case when b.natural_key is null then 'create' else 'replace' end as action
from fx_log_a a left join fx_log_b b on a.natural_key = b.natural_key
where b.natural_key is null or a.data is distinct from b.data or a.created is distinct from b.created""")
def _(v):
    cols = ["natural_key", "data", "created"]
    rows = R.changed_only(
        v("fx_log_a").select(cols), v("fx_log_b").select(cols), ["natural_key"]
    )
    return rows.select("natural_key", "action")


@query("snk05_update_by_key", """
with c as (select *, row_number() over (partition by lower(username) order by changed desc, seq desc) as rn from fx_password_change)
select m.username, case when c.username is null then 'old' else c.password end as password, coalesce(epoch_us(c.changed), epoch_us(timestamp '2000-01-01 00:00:00')) as modified_us
from fx_mailbox m left join c on lower(c.username) = lower(m.username) and c.rn = 1""")
def _(v):
    target = directory(v)["mailbox"].select(
        "username", F.lit("old").alias("password"),
        F.lit("2000-01-01").cast("timestamp").alias("modified"),
    )
    out = R.update_by_key(
        target, v("fx_password_change"), "username", ["password"], "changed", ["changed", "seq"]
    )
    return out.select("username", "password", S.epoch_us("modified").alias("modified_us"))


@query("sort01_latest", "select id, natural_key, data from fx_log_a order by id desc limit 1")
def _(v):
    return R.latest(v("fx_log_a").select("id", "natural_key", "data"), "id")


@query("sort01_latest_per_key", """
select domain, id, action from (select *, row_number() over (partition by domain order by id desc) as rn from fx_audit) where rn = 1""")
def _(v):
    return R.latest_by(v("fx_audit").select("domain", "id", "action"), ["domain"], ["id"])


@query("sort02_page", "select username, quota from fx_mailbox where username > 'u1200@' order by username limit 50")
def _(v):
    return R.page(v("fx_mailbox").select("username", "quota"), "username", "u1200@", 50)


@query("sort04_evidence", "select id, node, id % 2 as parity from fx_id order by id")
def _(v):
    return R.evidence(v("fx_id").select("id", "node", S.parity("id").alias("parity")), "id")


@query("udf02_row_hash", """
select natural_key, sha256('{"data":"' || data || '","natural_key":"' || natural_key || '"}') as hash from fx_log_a""")
def _(v):
    return v("fx_log_a").select("natural_key", S.row_hash("data", "natural_key").alias("hash"))
