"""Message store queries: merging, quota, folders, routing, headers, training, vacation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailfleet.catalog.registry import AS_OF, as_of, directory, query
from mailfleet.functions import scalars as S
from mailfleet.operators import messages as M
from mailfleet.operators import replicas as R
from mailfleet.plans.session import checkpointed
from mailfleet.sources.fixtures import Views
from mailfleet.sources.logs import parse_mail_events
from mailfleet.sources.records import header_list, parse_headers
from mailfleet.sources.schema import conform


def stores(v: Views):
    msg = v("fx_msg")
    return msg.where("node = 'A'"), msg.where("node = 'B'")


MERGED = """
with a as (select * from fx_msg where node = 'A'), b as (select * from fx_msg where node = 'B'),
merged as (
 select coalesce(a.username, b.username) as username, coalesce(a.guid, b.guid) as guid,
  case when b.guid is null or a.modseq > b.modseq or (a.modseq = b.modseq and a.flags >= b.flags) then a.flags else b.flags end as flags,
  case when b.guid is null or a.modseq > b.modseq then a.folder when a.guid is null or b.modseq > a.modseq then b.folder else greatest(a.folder, b.folder) end as folder,
  greatest(coalesce(a.modseq, 0), coalesce(b.modseq, 0)) as modseq, greatest(coalesce(a.expunged, 0), coalesce(b.expunged, 0)) as expunged, coalesce(a.vsize, b.vsize) as vsize, coalesce(a.saved_at, b.saved_at) as saved_at,
  case when greatest(coalesce(a.expunged, 0), coalesce(b.expunged, 0)) = 1 then 'expunge' when b.guid is null then 'copy_to_b' when a.guid is null then 'copy_to_a'
   when a.modseq <> b.modseq or a.flags <> b.flags or a.folder <> b.folder then 'update' else 'none' end as action
 from a full join b on a.username = b.username and a.guid = b.guid)
"""


@query("src05_parse_mail_events", """
select doc_id, split_part(split_part(line, '(', 2), ')', 1) as username, 'sg1' as node, regexp_extract(line, ': ([a-z_]+): uid', 1) as event, cast(regexp_extract(line, 'uid=([0-9]+)', 1) as bigint) as uid,
 regexp_extract(line, 'box=([^,]*), msgid', 1) as box, regexp_extract(line, 'msgid=([^,]*), size', 1) as msgid, cast(regexp_extract(line, 'size=([0-9]+)', 1) as bigint) as size, 'a@b.org' as from_addr, 'Re: hello, you' as subject, regexp_extract(line, 'flags=\\(([^)]*)', 1) as flags
from fx_mail_event_line where regexp_extract(line, ': ([a-z_]+): uid', 1) in ('delete', 'undelete', 'expunge', 'copy', 'mailbox_delete', 'mailbox_rename', 'flag_change')""")
def _(v):
    return parse_mail_events(v("fx_mail_event_line"), keep=("doc_id",))


@query("src10_parse_headers", """
select guid, 2 as received, nullif('X-Mailer: Client ' || cast(guid % 4 as varchar), '') as mailer, 'by sg1' as hop, repeat('*', cast(guid % 13 as int)) as stars, case when guid % 9 = 0 then 'Yes' end as spam from fx_header""")
def _(v):
    rows = parse_headers(v("fx_header"), keep=("guid",))

    def first(name):
        return F.try_element_at(F.col("headers"), F.lit(name))[0]

    hop = F.regexp_extract(F.try_element_at(F.col("headers"), F.lit("received"))[1], r"by sg1", 0)
    return rows.select(
        "guid", F.size(F.try_element_at(F.col("headers"), F.lit("received"))).alias("received"),
        F.concat(F.lit("X-Mailer: "), first("x-mailer")).alias("mailer"), hop.alias("hop"),
        first("x-spam-level").alias("stars"), first("x-spam").alias("spam"),
    )


@query("join12_merge_stores", MERGED + "select username, guid, folder, flags, modseq, expunged, vsize, epoch_us(saved_at) as saved_us, action from merged")
def _(v):
    merged = M.merge_stores(*stores(v))
    return merged.withColumn("saved_us", S.epoch_us("saved_at")).drop("saved_at")


@query("join12_at_resurrection_risk", MERGED + """
select username, guid from merged where action in ('copy_to_a', 'copy_to_b') and saved_at < timestamp '2024-01-01 00:00:00'""")
def _(v):
    merged = M.merge_stores(*stores(v))
    since = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return M.at_resurrection_risk(merged, since, 14 * 86400, as_of()).select("username", "guid")


@query("win04_latest_by", """
select guid, modseq, flags from (select *, row_number() over (partition by guid order by modseq desc, node desc) as rn from fx_msg) where rn = 1""")
def _(v):
    rows = v("fx_msg").select("guid", "modseq", "node", "flags")
    return R.latest_by(rows, ["guid"], ["modseq", "node"]).drop("node")


@query("agg04_mailbox_status", """
select username, folder, count(*) as messages, cast(sum(vsize) as bigint) as vsize from fx_msg where node = 'A' group by 1, 2""")
def _(v):
    return M.mailbox_status(stores(v)[0])


@query("agg06_quota_usage", """
select m.username, m.quota, cast(coalesce(u.bytes, 0) as bigint) as bytes, coalesce(u.n, 0) as messages, case when m.quota > 0 then floor(coalesce(u.bytes, 0) * 100.0 / m.quota) end as percent,
 case when m.quota > 0 and coalesce(u.bytes, 0) > m.quota then 1 else 0 end as over
from fx_mailbox m left join (select username, sum(vsize) as bytes, count(*) as n from fx_msg where node = 'A' and folder not in ('Trash', 'Junk') group by 1) u on u.username = m.username""")
def _(v):
    rows = M.quota_usage(stores(v)[0], directory(v)["mailbox"])
    return rows.withColumn("percent", F.col("percent").cast("double"))


@query("win13_quota_crossings", """
with t as (select f.username, f.doc_id, f.vsize, m.quota, sum(f.vsize) over (partition by f.username order by f.saved_at, f.doc_id rows unbounded preceding) as total
 from fx_usage f join fx_mailbox m on m.username = f.username where f.folder not in ('Trash', 'Junk') and m.quota > 0),
s as (select *, case when total * 100 > quota * 100 then 100 when total * 100 > quota * 95 then 95 when total * 100 > quota * 80 then 80 else 0 end as step,
 case when (total - vsize) * 100 > quota * 100 then 100 when (total - vsize) * 100 > quota * 95 then 95 when (total - vsize) * 100 > quota * 80 then 80 else 0 end as was from t)
select username, doc_id, cast(total as bigint) as total, quota, step from s where step > was""")
def _(v):
    return M.quota_crossings(v("fx_usage"), directory(v)["mailbox"])


@query("fil13_expired_messages", f"""
select guid, node, folder from fx_msg where (folder = 'Junk' and epoch(timestamp '{AS_OF}') - epoch(saved_at) > 30 * 86400) or (folder = 'Trash' and epoch(timestamp '{AS_OF}') - epoch(saved_at) > 60 * 86400)""")
def _(v):
    return M.expired_messages(v("fx_msg"), as_of()).select("guid", "node", "folder")


_PURPOSE = """case folder when 'Drafts' then 'Drafts' when 'Sent' then 'Sent' when 'Sent Items' then 'Sent' when 'Sent Messages' then 'Sent' when 'Junk' then 'Junk' when 'Spam' then 'Junk'
 when 'Trash' then 'Trash' when 'Deleted Items' then 'Trash' when 'Archive' then 'Archive' end"""


@query("join21_special_use", f"select doc_id, username, folder, {_PURPOSE} as purpose from fx_folder")
def _(v):
    return M.special_use(v("fx_folder"))


@query("join21_duplicate_folders", f"""
select username, purpose, count(distinct folder) as folders from (select username, folder, {_PURPOSE} as purpose from fx_folder) where purpose is not null group by 1, 2 having count(distinct folder) > 1""")
def _(v):
    return M.duplicate_folders(v("fx_folder"))


@query("rul06_route_messages", """
select guid, case when guid % 9 = 0 or guid % 13 >= 10 then 'Junk' when guid % 11 = 0 then 'Reports' else 'INBOX' end as folder, case when guid % 9 = 0 or guid % 13 >= 10 then 1 else 0 end as seen from fx_header""")
def _(v):
    return M.route_messages(v("fx_header")).select("guid", "folder", "seen")


@query("rul07_clean_headers", """
with l as (select guid, submitted, unnest(string_split(raw, chr(10))) as line, generate_subscripts(string_split(raw, chr(10)), 1) as i from fx_header),
k as (select guid, i, case when submitted = 1 then regexp_replace(line, '^Message-ID:\\s*<(.+)@[^>]+>', 'Message-ID: <\\1@example.com>') else line end as line from l
 where not regexp_matches(line, '^Bcc:') and not (submitted = 1 and (regexp_matches(line, '^Received:.*with E?SMTPS?A[; ]') or regexp_matches(line, '^X-Mailer:'))))
select guid, string_agg(line, chr(10) order by i) as clean from k group by guid""")
def _(v):
    return M.clean_headers(v("fx_header"), "example.com").select("guid", "clean")


@query("udf04_compiled_rules", """
select folder, cast(sum(seen) as bigint) as seen, count(*) as messages from (select case when guid % 9 = 0 or guid % 13 >= 10 then 'Junk' when guid % 11 = 0 then 'Reports' else 'INBOX' end as folder,
 case when guid % 9 = 0 or guid % 13 >= 10 then 1 else 0 end as seen from fx_header) group by folder""")
def _(v):
    return M.route_messages(v("fx_header")).groupBy("folder").agg(
        F.sum("seen").alias("seen"), F.count(F.lit(1)).alias("messages")
    )


@query("rul08_training_labels", """
select guid, case when to_folder = 'Junk' then 'spam' else 'ham' end as label from fx_move where to_folder = 'Junk' or (from_folder = 'Junk' and to_folder <> 'Trash')""")
def _(v):
    return M.training_labels(v("fx_move")).select("guid", "label")


_TOKENS = r"""
with tok as (select distinct doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as token from documents),
lab as (select doc_id, toxic as is_spam from labels),
model as (select token, count(*) filter (is_spam = 1) as spam, count(*) filter (is_spam = 0) as ham from tok join lab using (doc_id) where token <> '' group by token)
"""


def _labels(v: Views):
    return v("labels").select("doc_id", F.col("toxic").alias("is_spam"))


def _model(v: Views):
    """Trained on the labelled messages; only their text is cut into words."""
    labels = _labels(v)
    learned = v("documents").join(labels, "doc_id", "left_semi")
    return M.bayes_train(M.message_tokens(learned), labels)


@query("agg14_bayes_train", _TOKENS + "select token, spam, ham from model")
def _(v):
    return _model(v)


@query("agg14_bayes_score", _TOKENS + """,
n as (select count(*) filter (is_spam = 1) as ns, count(*) filter (is_spam = 0) as nh from lab)
select doc_id, count(*) as tokens, case when max(ns) >= 5 and max(nh) >= 5 and count(*) >= 11 then round(sum(ln(((spam + 1) / (ns + 2)) / ((ham + 1) / (nh + 2)))), 6) end as log_odds
from tok join model using (token), n where token <> '' group by doc_id""")
def _(v):
    tokens = M.message_tokens(v("documents"))
    # The labels here have few spam messages; the threshold is an argument.
    scored = M.bayes_score(tokens, checkpointed(_model(v), "model"), _labels(v), min_learns=5)
    return scored.withColumn("log_odds", F.round("log_odds", 6))


@query("join20_vacation_replies", """
with recursive away as (
 select m.rcpt, m.sender, cast(floor(epoch(m.ts)) as bigint) as second, cast(v.interval_time as bigint) as gap, cast(floor(epoch(n.notified_at)) as bigint) as noted
 from fx_vacation_msg m join fx_vacation v on v.email = m.rcpt and v.active = 1 and m.ts between v.activefrom and v.activeuntil
 left join fx_notified n on n.on_vacation = m.rcpt and n.notified = m.sender),
cand as (select distinct rcpt, sender, second, gap from away where noted is null or second < noted or (gap > 0 and second >= noted + gap)),
nxt as (select a.rcpt, a.sender, a.second, (select min(b.second) from cand b where b.rcpt = a.rcpt and b.sender = a.sender and a.gap > 0 and b.second >= a.second + a.gap) as next_second from cand a),
walk as (select rcpt, sender, min(second) as second from cand group by 1, 2
 union all select w.rcpt, w.sender, x.next_second from walk w join nxt x on x.rcpt = w.rcpt and x.sender = w.sender and x.second = w.second where x.next_second is not null)
select rcpt, sender, second from walk""")
def _(v):
    return M.vacation_replies(
        v("fx_vacation_msg"), conform(v("fx_vacation"), "vacation"), v("fx_notified")
    )


@query("join22_verify_manifest", """
with f as (select bundle, name, sha256(content) as have from fx_bundle_file), m as (select bundle, name, sha256(content) as listed from fx_bundle_src),
s as (select coalesce(f.bundle, m.bundle) as bundle, coalesce(f.name, m.name) as name, case when f.name is null then 'absent' when m.name is null then 'unlisted' when have <> listed then 'differs' else 'ok' end as state
 from f full join m on f.bundle = m.bundle and f.name = m.name)
select bundle, name, state, min(case when state = 'ok' then 1 else 0 end) over (partition by bundle) as accepted from s""")
def _(v):
    from mailfleet.operators.posture import verify_manifest

    manifest = v("fx_bundle_src").select("bundle", "name", F.sha2("content", 256).alias("sha256"))
    return verify_manifest(v("fx_bundle_file"), manifest)


@query("str09_delivery_outcomes", """
with a as (select queue_id, delivered_after_h * 3600 as s from fx_delivery),
l as (select *, case when s is not null and s < 259200 then s else 259200 end as lived from a)
select queue_id, case when lived >= 14400 then 1 else 0 end as warned, case when s is not null and s < 259200 then 'delivered' else 'bounced' end as outcome from l""")
def _(v):
    queue = v("fx_delivery").select(
        "queue_id", (F.col("delivered_after_h") * 3600).alias("delivered_after_s")
    )
    return M.delivery_outcomes(queue)


SESSIONS = """
with named as (select username, session_id, cast(min(floor(epoch(ts))) as bigint) as start, cast(max(floor(epoch(ts))) as bigint) as "end", count(*) as events from fx_session where session_id <> '' group by 1, 2),
g as (select username, cast(floor(epoch(ts)) as bigint) as s from fx_session where session_id = ''),
p as (select *, lag(s) over (partition by username order by s) as before from g),
n as (select *, sum(case when before is null or s - before >= 14400 then 1 else 0 end) over (partition by username order by s rows unbounded preceding) as number from p),
sessions as (select username, session_id, start, "end", events from named union all select username, '', min(s), max(s), count(*) from n group by username, number)
select username, session_id, start, "end", events from sessions
"""


@query("str10_sessionize", SESSIONS)
def _(v):
    return M.sessionize(v("fx_session"), gap_s=14400)


@query("src10_header_order", """
select guid, string_agg(split_part(line, ':', 1), ',' order by i) as names from (select guid, unnest(string_split(raw, chr(10))) as line, generate_subscripts(string_split(raw, chr(10)), 1) as i from fx_header) group by guid""")
def _(v):
    names = F.transform(header_list("raw"), lambda h: h["name"])
    return v("fx_header").select("guid", F.array_join(names, ",").alias("names"))
