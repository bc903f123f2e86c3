"""Recipient resolution, senders and administration on small tables."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mailfleet.catalog.registry import directory
from mailfleet.operators import directory as D
from mailfleet.operators import lists as alias_lists
from mailfleet.operators.lists import expand_aliases
from mailfleet.plans import jumps
from mailfleet.plans.session import checkpointed
from mailfleet.sources.fixtures import Views
from mailfleet.sources.schema import conform


@pytest.fixture(scope="module")
def tables(spark):
    def make(name, rows, ddl):
        return conform(spark.createDataFrame(rows, ddl), name)

    return {
        "domain": make("domain", [("a.org", 0, 1), ("b.org", 1, 1), ("c.org", 0, 0), ("ALL", 0, 1)],
                       "domain string, backupmx int, active int"),
        "alias_domain": make("alias_domain", [("x.net", "a.org", 1), ("y.net", "a.org", 0)],
                             "alias_domain string, target_domain string, active int"),
        "alias": make("alias", [
            ("Info@A.org", "u1@a.org, ext@z.org", 1), ("@a.org", "post@a.org", 1),
            ("loop1@a.org", "loop2@a.org", 1), ("loop2@a.org", "loop1@a.org,u2@a.org", 1),
            ("old@a.org", "u1@a.org", 0),
        ], "address string, goto string, active int"),
        "mailbox": make("mailbox", [("u1@a.org", "a.org/u1/", 5, 1), ("u2@a.org", "a.org/u2/", 0, 1),
                                    ("gone@a.org", "a.org/gone/", 1, 0)],
                        "username string, maildir string, quota bigint, active int"),
    }


def routes(spark, tables, addresses, mode="strict"):
    df = spark.createDataFrame([(a,) for a in addresses], "rcpt string")
    return {r.rcpt: r.route for r in D.resolve_recipients(df, tables, mode).collect()}


def test_route_order(spark, tables):
    want = {
        "info@a.org": "alias", "INFO+tag@A.ORG": "alias", "info@x.net": "ad_alias",
        "u1@a.org": "catchall", "u1@x.net": "ad_catchall", "nobody@a.org": "catchall",
        "u@b.org": "relay_denied", "u@c.org": "relay_denied", "u@y.net": "relay_denied",
        "u@elsewhere.org": "relay_denied",
    }
    assert routes(spark, tables, want) == want
    boxes = routes(spark, tables, ["u1@a.org", "u1@x.net", "nobody@a.org", "gone@a.org"], "mailbox_first")
    assert boxes == {"u1@a.org": "mailbox", "u1@x.net": "ad_mailbox", "nobody@a.org": "catchall",
                     "gone@a.org": "catchall"}


def test_without_catchall(spark, tables):
    bare = {**tables, "alias": tables["alias"].where("address <> '@a.org'")}
    got = routes(spark, bare, ["u1@a.org", "u1@x.net", "gone@a.org", "zz@x.net"])
    assert got == {"u1@a.org": "mailbox", "u1@x.net": "ad_mailbox", "gone@a.org": "unlisted",
                   "zz@x.net": "unlisted"}


def test_known_counts(spark):
    """Counts over the 0.01 data, in route order."""
    views = Views(spark, "/root/testdata/sf0.01")
    strict = {r.route: r.recipients for r in D.route_counts(views("fx_rcpt"), directory(views)).collect()}
    assert [strict[r] for r in D.ROUTES] == [8020, 750, 250, 234, 1412, 2291, 390, 1653]
    other = D.route_counts(views("fx_rcpt"), directory(views), mode="mailbox_first")
    boxes = {r.route: r.recipients for r in other.collect()}
    assert (boxes["mailbox"], boxes["ad_mailbox"], boxes["ad_catchall"], boxes["catchall"]) == (
        3134, 607, 17, 569
    )


def test_one_route_per_recipient(spark, folder):
    views = Views(spark, folder)
    rows = D.resolve_recipients(views("fx_rcpt"), directory(views))
    assert rows.count() == views("fx_rcpt").count()
    assert rows.where("route is null").isEmpty()


def test_alias_lookup_retries_the_domain(spark, tables):
    df = spark.createDataFrame([("info@a.org",), ("any@a.org",), ("any@q.org",)], "rcpt string")
    got = {r.rcpt: (r.goto, r.matched) for r in D.alias_lookup(df, tables["alias"]).collect()}
    assert got == {"info@a.org": ("u1@a.org, ext@z.org", "address"),
                   "any@a.org": ("post@a.org", "domain")}


def test_expand(spark, tables):
    df = spark.createDataFrame([("info@a.org",), ("loop1@a.org",), ("u1@a.org",)], "address string")
    got = {tuple(r) for r in expand_aliases(df, tables["alias"]).select(
        "origin", "target", "kind", "depth").collect()}
    assert got == {
        ("info@a.org", "u1@a.org", "leaf", 1), ("info@a.org", "ext@z.org", "leaf", 1),
        ("loop1@a.org", "loop1@a.org", "cycle", 2), ("loop1@a.org", "loop2@a.org", "cycle", 1), ("loop1@a.org", "u2@a.org", "leaf", 2),
        ("u1@a.org", "u1@a.org", "leaf", 0),
    }


def test_expand_has_no_depth_limit(spark):
    alias = spark.createDataFrame(
        [(f"n{i}@a.org", f"n{i + 1}@a.org", 1) for i in range(14)],
        "address string, goto string, active int",
    )
    start = spark.createDataFrame([("n0@a.org",)], "address string")
    row = expand_aliases(start, alias).first()
    assert (row.target, row.kind, row.depth) == ("n14@a.org", "leaf", 14)


def test_expand_lists_that_meet_and_loop(spark):
    alias = spark.createDataFrame(
        [("o@x", "a@x,b@x", 1), ("a@x", "x@x", 1), ("b@x", "x@x", 1), ("x@x", "b@x", 1)],
        "address string, goto string, active int",
    )
    got = {(r.target, r.kind) for r in expand_aliases(
        spark.createDataFrame([("o@x",)], "address string"), alias).collect()}
    assert got == {("x@x", "cycle"), ("b@x", "cycle")}


ALIASES = "address string, goto string, active int"


def walked(lists, starts):
    """Targets, kinds and depths by walking from each start."""
    def steps(node):
        depth, now = {}, [node]
        for d in itertools.count(1):
            now = {t for n in now for t in lists.get(n, ()) if t not in depth}
            if not now:
                return depth
            depth.update(dict.fromkeys(now, d))

    out = set()
    for s in starts:
        reached = steps(s)
        out |= {(s, t, "leaf", d) for t, d in reached.items() if t not in lists}
        out |= {(s, t, "cycle", d) for t, d in reached.items() if t in lists and t in steps(t)}
        out |= {(s, s, "leaf", 0)} if s not in lists else set()
    return out


def expanded(spark, lists, starts):
    alias = spark.createDataFrame([(a, ",".join(t), 1) for a, t in lists.items()], ALIASES)
    df = spark.createDataFrame([(s,) for s in starts], "address string")
    return {tuple(r) for r in expand_aliases(df, alias).select("origin", "target", "kind", "depth").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_expand_by_walking(spark, seed):
    """Random lists: chains, trees, rings of one and of many, and rings that share lists."""
    rng = random.Random(seed)
    names = [f"n{i}@x" for i in range(40)]
    lists = {}
    for n in names[:30]:
        size = rng.choice([1, 1, 1, 2, 3])
        near = names[names.index(n) + 1:names.index(n) + 4] if rng.random() < [0.9, 0.6, 0.3][seed] else names
        lists[n] = sorted(set(rng.choices(near or names, k=size)))
    starts = rng.sample(names, 12) + ["other@x"]
    assert expanded(spark, lists, starts) == walked(lists, starts)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 10,000 lists, each with an address of its own, into a ring of three."""
    lists = {f"c{i:05}@x": [f"c{i + 1:05}@x", f"user{i}@x"] for i in range(10_000)}
    lists |= {"c10000@x": ["r1@x"], "r1@x": ["r2@x"], "r2@x": ["c10000@x", "out@x"]}
    lists |= {f"unasked{i}@x": ["c00000@x", "c05000@x"] for i in range(50)}
    rounds = []
    for module in (alias_lists, jumps):
        monkeypatch.setattr(module, "checkpointed", lambda df, name: rounds.append(name) or checkpointed(df, name))
    got = expanded(spark, lists, ["c00000@x", "c09998@x"])
    assert got == walked(lists, ["c00000@x", "c09998@x"])
    assert len(got) > 10_000 and len(rounds) < 30


def test_spoofed_sender_is_refused(spark, tables):
    df = spark.createDataFrame(
        [("u1@a.org", "u1@a.org"), ("u2@a.org", "u1@a.org"), ("info@a.org", "U1@a.org"),
         ("old@a.org", "u1@a.org")], "rcpt string, sasl_login string")
    ok = D.sender_authorised(df, tables["mailbox"], tables["alias"])
    bad = D.sender_authorised(df, tables["mailbox"], tables["alias"], authorised=False)
    assert sorted(r.rcpt for r in ok.collect()) == ["info@a.org", "u1@a.org"]
    assert sorted(r.rcpt for r in bad.collect()) == ["old@a.org", "u2@a.org"]


def test_login_is_a_part_of_delivery(spark, folder):
    views = Views(spark, folder)
    box, keys = directory(views)["mailbox"], views("fx_mailbox").select(F.col("username").alias("rcpt"))
    as_of = F.lit("2024-02-01").cast("timestamp")
    login = {r.user for r in D.auth_lookup(keys, box, as_of).collect()}
    delivery = {r.user for r in D.user_lookup(keys, box).collect()}
    assert login < delivery


def test_tls_default(spark):
    dest = spark.createDataFrame([("a.org",), ("b.org",), ("c.org",)], "domain string")
    policy = spark.createDataFrame(
        [("a.org", "secure", "match=x", 1), ("b.org", "encrypt", "", 0), ("c.org", "none", "", 1)],
        "domain string, policy string, params string, active int")
    got = {r.domain: r.tls for r in D.tls_policy(dest, policy).collect()}
    assert got == {"a.org": "secure match=x", "b.org": "may", "c.org": "none"}
