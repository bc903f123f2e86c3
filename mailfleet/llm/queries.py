"""The numbered operators as queries over a data folder, next to SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailfleet.llm import bpe, lm, quality, toxicity
from mailfleet.llm.chat import format_turns, read_back
from mailfleet.llm.decontaminate import overlaps
from mailfleet.llm.exact import exact_groups
from mailfleet.llm.jaccard import similar_groups
from mailfleet.llm.labelled import fold_of
from mailfleet.llm.license import PHRASES, TEMPLATES, license_labels
from mailfleet.llm.pieces import token_counts
from mailfleet.llm.trie import conversation_trie
from mailfleet.llm.urls import Rule, judged as judged_urls
from mailfleet.llm.whiten import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A conversation that talks like the markers of the template.
CONTROL_ROWS = "values (-7L, 0L, 'user', {0}), (-7L, 1L, 'assistant', {0}) as t(conv_id, turn, role, text)".format(
    r"'\\### Assistant: </turn> ok'")


@query(r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, replace(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ': ', '\: ') as said,
    replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ': ', '\: ') as who from c),
a as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as all_text,
    coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss,
    sum(length('### ' || who || ': ' || said || '</turn>' || chr(10)))::bigint as formatted_chars
  from e group by conv_id)
select conv_id, n_turns, sha256(all_text) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from a""")
def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(given.unionByName(spark.sql("select * from " + CONTROL_ROWS))))


@query()
def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return lm.scored(
        table(spark, folder, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    """A class per score, and whether the labels of the row's fold were held out."""
    return scored.withColumns({
        "held_out": F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)),
        "predicted": (F.col("score") >= threshold).cast("int")})


@query()
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged(scored, 0.3)


@query()
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged(scored, 0.5)


@query("""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as x from documents)
select doc_id, min(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
       doc_id = min(doc_id) over (partition by x) as kept, sha256(x) as text_sha256
from t""")
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"), all_digests=True)


@query()
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


def token_digests(docs: DataFrame) -> DataFrame:
    """Ids of every text, and of what they decode to, as digests."""
    import public_tokenizers

    path = tokenizer("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, with_digests=True)


URL_RULES = (
    Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"), Rule("block", "net/fr/"),
)


@query(r"""
with recursive u as (
  select page_id, coalesce(url, '') as u, regexp_extract_all(coalesce(html, ''), '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>') as c,
    regexp_extract_all(coalesce(html, ''), '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>') as m from pages),
p as (
  select *, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, u as own from u),
t as (
  select host as h, path, u, replace(unnest(list_concat(list_transform(c, lambda g: regexp_extract(g, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)),
    list_transform(m, lambda g: regexp_extract(g, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)))), '&amp;', '&') as x from p),
l as (
  select u as s, case when regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.\-]*:') then x when x like '//%' then 'http:' || x when x like '/%' then 'http://' || h || x
    when x like '?%' then 'http://' || h || path || x else 'http://' || h || case when path like '%/%' then regexp_extract(path, '(?s)^(.*/)', 1) else '/' end || x end as d
  from t where x <> '' and x not like '#%'),
n as (
  select v, case when v like '%://%' then translate(regexp_extract(v, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || case when r = '' then '/' when contains(r, '/.') then '/' || array_to_string(list_reduce(list_transform(
        list_concat(string_split(substr(r, 2), '/'), case when r like '%/.' or r like '%/..' then [''] else [] end), lambda g: [g]),
        lambda held, g: case when g[1] = '..' then held[1:len(held) - 1] when g[1] = '.' then held else list_concat(held, g) end, cast([] as varchar[])), '/')
      else r end || q end as node
  from (select v, regexp_extract(v, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as r, regexp_extract(v, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) as q
    from (select u as v from p union select s from l union select d from l))),
e as (select distinct a.node as a, b.node as b from l join n a on a.v = s join n b on b.v = d where a.node <> b.node),
e2 as (select a, b from e union select b, a from e),
r as (select a, b from e2 union select r.a, e2.b from r join e2 on r.b = e2.a),
rules(verdict, rule) as (values ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
judge as (
  select x.node, max_by(verdict, length(rule)) as verdict, max_by(rule, length(rule)) as rule
  from (select distinct node, split_part(node, '/', 1) as host, regexp_extract(node, '^[^/]*([^?]*)', 1) as path from n where node is not null) x
  join rules on (host = split_part(rule, '/', 1) or host like '%.' || split_part(rule, '/', 1)) and starts_with(path, substr(rule, strpos(rule, '/')))
  group by x.node)
select page_id, host, path, own.rule as rule,
  coalesce(own.verdict, (select min(j.verdict) from r join judge j on j.node = r.b where r.a = n.node), 'allow') as verdict,
  (select min(b) from r where r.a = n.node) as alias_of
from p join n on n.v = p.u left join judge own on own.node = n.node""")
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged_urls(table(spark, folder, "pages"), URL_RULES)


@query()
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"))


@query("""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as x from documents),
s as (
  select doc_id, case when len(x) = 0 then [] when len(x) < 3 then [array_to_string(x, ' ')]
    else list_distinct(list_transform(range(1, len(x) - 1), lambda i: array_to_string(x[i:i + 2], ' '))) end as s from w),
t as (select doc_id, len(s) as n, unnest(s) as t from s),
e as (
  select a.doc_id as a, b.doc_id as b from t a join t b on a.t = b.t and a.doc_id <> b.doc_id
    and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a)
select doc_id, len(s) as n_shingles, least(doc_id, coalesce((select min(b) from r where r.a = doc_id), doc_id)) as component_id
from s""")
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "documents"))


@query()
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(table(spark, folder, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def _sql_words(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in re.findall("[a-z0-9]+", text.lower())) + "]"


@query(r"""
with phrase(label, p) as (values """ + ", ".join(f"('{label}', {_sql_words(text)})" for label, text in PHRASES) + r"""),
template(label, p) as (values """ + ", ".join(f"('{label}', {_sql_words(text)})" for label, text in TEMPLATES) + r"""),
held as (select row_number() over () as t, label, len(p) as width, list_distinct(p) as own, len(list_distinct(p)) as size,
  cast(ceil(4 * len(list_distinct(p)) / 5) as bigint) as least from template),
token as (select t, label, width, size, least, unnest(own) as word from held),
w as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as x from documents),
u as (select rid, unnest(x) as word, generate_subscripts(x, 1) - 1 as pos from w),
base as (select u.rid, label, pos from u join phrase on word = p[1] join w on w.rid = u.rid where x[pos + 1 : pos + len(p)] = p),
o as (select rid, t, label, width, size, least, pos,
    coalesce(lag(pos) over (partition by rid, t, word order by pos), -1) as prev from u join token using (word)),
ev as (select rid, t, label, size, least, greatest(prev + 1, pos - width + 1, 0) as spot, 1 as step from o
  union all select rid, t, label, size, least, pos + 1, -1 from o),
sums as (select rid, t, label, size, least, spot, sum(step) as step from ev group by all),
level as (select *, sum(step) over (partition by rid, t order by spot) as common from sums),
run as (select *, lag(common) over (partition by rid, t order by spot) as before from level),
hit as (select rid, label, max(common / size) as containment, count(*) filter (coalesce(before, 0) < least) as n from run where common >= least group by rid, t, label),
b as (select rid, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by rid),
h as (select rid, sum(n) as n_blocks, max(containment) as c from hit group by rid),
l as (select rid, string_agg(distinct label, ',' order by label) as labels from (select rid, label from base union select rid, label from hit) group by rid)
select doc_id, len(x) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, cast(coalesce(n_blocks, 0) as bigint) as n_blocks, case when n_base > 0 then 1.0 else coalesce(c, 0) end as score
from w left join b using (rid) left join h using (rid) left join l using (rid)""")
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_labels(table(spark, folder, "documents"))


@query(r"""
with ids as (
  select distinct conv_id as c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(cast(conv_id as varchar), ''), lambda s: cast(ascii(s) as bigint))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda q, i: xor(q >> 1, 3988292384 * (q & 1))))) % 9 as h
  from conversations where conv_id is not null),
o as (
  select conv_id as c, k, bytes, row_number() over (partition by conv_id order by turn nulls first, k) as pos from (
    select *, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, strlen(coalesce(text, '')) as bytes
    from conversations where conv_id is not null)),
src as (
  select ids.c, 0 as own, pos, k, bytes from ids join o on o.c = ids.c - ids.c % 5 and pos <= h
  union all select ids.c, 1, pos, k, bytes from ids join o on o.c = ids.c and pos > h),
r as (select c, k, bytes, row_number() over (partition by c order by own, pos) as depth from src),
m as (
  select c, depth, bytes, md5(string_agg(k, ' ') over (partition by c order by depth)) as node,
    coalesce(md5(string_agg(k, ' ') over (partition by c order by depth rows between unbounded preceding and 1 preceding)), '') as parent from r
  union all select c, 0, 0, '', null from ids),
n as (select node, depth, min(c) as conv_id, count(*) as n_convs, max(parent) as parent, (count(*) - 1) * max(bytes) as own from m group by node, depth),
kids as (select parent, count(*) as n from n where depth > 0 group by parent),
below as (select distinct a.node, b.node as down from m a join m b on a.c = b.c and b.depth >= a.depth),
tree as (
  select below.node, sum(n.own) as saved, count(*) filter (kids.n is null) as leaves
  from below join n on n.node = down left join kids on kids.parent = down group by below.node),
last as (select c, max_by(node, depth) as node from m group by c),
ends as (select node, sha256(string_agg(cast(c as varchar), ',' order by c)) as sha from last group by node)
select n.conv_id, cast(n.depth as bigint) as depth, up.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children, leaves as n_leaves,
  cast(saved as bigint) as saved_tokens, coalesce(sha, sha256('')) as ends_sha256
from n join tree using (node) left join n up on up.node = n.parent left join kids on kids.parent = n.node left join ends on ends.node = n.node""")
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))
