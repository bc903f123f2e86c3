"""Bans, limits and sessions against step-by-step simulations, and sample lines."""

from __future__ import annotations

import datetime
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from mailfleet.functions.rules import FILTERS, LogFilter, compile_filter, filter_named
from mailfleet.operators import abuse as A
from tests.compare import rows_of


def simulate_bans(times, need, find, hold):
    """One failure at a time."""
    recent, until, out = [], None, []
    for t in sorted(times):
        if until is not None and t < until:
            continue
        recent = [x for x in recent if x >= t - find] + [t]
        if len(recent) >= need:
            until, recent = t + hold, []
            out.append((t, until))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ban_ledger_is_exact(spark, seed):
    rng = random.Random(seed)
    jails = {"j": A.Jail(3, "60s", "5m"), "q": A.Jail(5, "10m", "60s"), "off": A.Jail(1, enabled=False)}
    rows = [
        (rng.choice(["j", "j", "q", "off"]), rng.choice(["h", "h", "h", "i"]), rng.randrange(9000))
        for _ in range(700)
    ]
    df = spark.createDataFrame(rows, "jail string, ip string, t bigint").withColumn(
        "ts", F.timestamp_seconds("t")
    )
    want = set()
    for jail in ("j", "q"):
        for ip in ("h", "i"):
            times = [t for a, b, t in rows if (a, b) == (jail, ip)]
            rule = jails[jail]
            for start, end in simulate_bans(times, rule.maxretry, rule.find_s, rule.ban_s):
                want.add((jail, ip, start, end))
    assert {tuple(r) for r in A.ban_ledger(df, jails).collect()} == want


def test_stock_jails(spark):
    assert len(A.JAILS) + 1 == 11 and len(A.enabled(A.JAILS)) + 1 == 10
    assert A.RECIDIVE.find_s == 86400 and A.RECIDIVE.ban_s == 7 * 86400
    # Five failures in ten minutes trip the mail jail, four do not.
    rows = [("smtp", "x", 60 * i) for i in range(5)] + [("smtp", "y", 60 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "jail string, ip string, t bigint").select(
        "jail", "ip", F.timestamp_seconds("t").alias("ts")
    )
    assert [tuple(r) for r in A.ban_events(df).collect()] == [("smtp", "x", 240, 5)]
    assert [tuple(r) for r in A.ban_ledger(df).collect()] == [("smtp", "x", 240, 240 + 3600)]


def test_requests_while_banned(spark):
    bans = spark.createDataFrame([("a", 100, 8000), ("a", 7000, 7300)], "ip string, start bigint, end bigint")
    req = spark.createDataFrame(
        [(1, "a", 99), (2, "a", 100), (3, "a", 7100), (4, "a", 7999), (5, "a", 8000), (6, "b", 200)],
        "n bigint, ip string, t bigint",
    ).withColumn("ts", F.timestamp_seconds("t"))
    got = A.requests_while_banned(req, bans).select("n").collect()
    assert sorted(r.n for r in got) == [2, 3, 4]


def test_ignored_networks(spark):
    rows = [("127.9.9.9",), ("::1",), ("10.77.0.200",), ("10.77.1.1",), ("203.0.113.10",), ("x",)]
    df = spark.createDataFrame(rows, "ip string")
    ignore = ("127.0.0.1/8", "::1", "203.0.113.10", "10.77.0.0/24")
    assert sorted(r.ip for r in A.not_ignored(df, ignore).collect()) == ["10.77.1.1", "x"]


LINES = [
    ("webmail", "[09-Sep-2026 22:35:02 +0000]: <s> IMAP Error: Login failed for alice@example.com "
     "against 127.0.0.1 from 203.0.113.55. AUTHENTICATE PLAIN: x", "203.0.113.55"),
    ("webmail", "[09-Sep-2026 22:35:09 +0000]: <s> Failed login for bob@example.com from "
     "203.0.113.55 in session abc124 (error: 0)", "203.0.113.55"),
    ("webmail", "[09-Sep-2026 22:35:09 +0000]: <s> Successful login for bob@example.com from "
     "203.0.113.55 in session abc124", None),
    ("admin", '203.0.113.7 - - [09/Sep/2026:22:30:01 +0000] "POST /login.php HTTP/2.0" 200 512 "-" '
     '"x" rt=0.1 node=sg1', "203.0.113.7"),
    ("admin", '203.0.113.7 - - [09/Sep/2026:22:30:01 +0000] "POST /login.php HTTP/2.0" 302 5 "-" '
     '"x" rt=0.1 node=sg1', None),
    ("imap-ext", "2026-09-09 22:30:01 managesieve-login: Info: Aborted login (no auth attempts): "
     "user=<>, rip=2001:db8::7, lip=10.0.0.1", "2001:db8::7"),
    ("imap-ext", "2026-09-09 22:30:01 doveadm(x): Error: doveadm client: y: Authentication failed "
     "from 10.77.0.2", "10.77.0.2"),
]


@pytest.mark.parametrize("jail,line,ip", LINES)
def test_filter_lines(spark, jail, line, ip):
    compiled = compile_filter(filter_named(jail), F.col("line"))
    row = spark.createDataFrame([(line,)], "line string").select(
        compiled.is_failure.alias("f"), compiled.ip.alias("ip"), compiled.ts.alias("ts")
    ).first()
    assert row.f == (ip is not None)
    assert row.ts.year == 2026 and row.ts.month == 9
    if ip:
        assert row.ip == ip


def test_filters_are_validated():
    with pytest.raises(ValueError, match="exactly one"):
        LogFilter("x", "imap", r"\d", ("<HOST> and <HOST>",))
    with pytest.raises(ValueError, match="exactly one"):
        LogFilter("x", "imap", r"\d", ("nothing",))
    with pytest.raises(ValueError, match="time format"):
        LogFilter("x", "never", r"\d", ("<HOST>",))
    assert {f.jail for f in FILTERS} <= set(A.JAILS)


def test_odd_access_lines(spark):
    from mailfleet.sources.logs import parse_access_log

    rows = [
        ('1.2.3.4 - bob [09/Sep/2026:22:30:01 +0200] "GET /a?b=c HTTP/1.1" 304 - "https://x/" '
         '"Agent (a; b)" rt=1.250 node=us1',),
        ("garbage",), (None,), ('1.2.3.4 - - [x] "" 400 0 "-" "-" rt=0.000 node=us1',),
    ]
    got = parse_access_log(spark.createDataFrame(rows, "line string")).collect()
    first = got[0]
    assert (first.remote_user, first.path, first.status, first.bytes) == ("bob", "/a?b=c", 304, None)
    assert (first.rt, first.node, first.agent) == (1.25, "us1", "Agent (a; b)")
    assert first.ts.hour == 20
    assert got[1].ip is None and got[2].ip is None and got[3].status == 400


def test_ipv6_subnets_are_ignored(spark):
    ips = ["2001:db8::1", "2001:DB8:0:0:ffff::", "2001:db9::1", "::1", "0:0:0:0:0:0:0:1", "::2", "fe80::1:2", "1.2.3.4", "a:b", None, "x"]
    df = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    ignore = ["2001:db8::/32", "::1", "fe80::/10", "1.2.3.0/24"]
    assert [r.ip for r in A.not_ignored(df, ignore).collect()] == ["2001:db9::1", "::2", "a:b", None, "x"]


BUSY = {"smtp": A.Jail(3, "60s", "200s"), "webmail": A.Jail(5, "30s", "90s"), "admin": A.Jail(1, "10s", "50s"), "dovecot": A.Jail(2, "300s", "10s")}


def busy_fails(spark, seed, seconds=2000):
    """Sources that hardly ever pause, one of them null, with several failures in a second."""
    rng = random.Random(seed)
    rows = []
    for jail in BUSY:
        for ip, share in (("a", 0.9), ("b", 0.04), ("c", 0.015), (None, 0.3)):
            rows += [(jail, ip, s) for s in range(seconds) for _ in range(rng.choice([1, 1, 2])) if rng.random() < share]
    return spark.createDataFrame(rows, "jail string, ip string, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")


@pytest.mark.parametrize("seed", range(2))
def test_pointers_and_fold_give_the_same_bans(spark, seed):
    fails = busy_fails(spark, seed)
    folded = rows_of(A.ban_ledger(fails, BUSY))
    assert rows_of(A.ban_ledger(fails, BUSY, longest=[0, 300][seed])) == folded
    assert {r[-1] for r in folded} and len({(r[1], r[2]) for r in folded}) > 4


def test_a_source_that_never_pauses_is_not_folded(spark, monkeypatch):
    """One source, 300,000 seconds, a ban every 3,600 of them: nothing of it reaches the fold."""
    seconds = spark.range(300_000).select(
        F.lit("smtp").alias("jail"), F.lit("x").alias("ip"), F.timestamp_seconds("id").alias("ts"))
    monkeypatch.setattr(A, "hold_off", None)
    got = A.ban_ledger(seconds, {"smtp": A.Jail(5, "10m", "1h")})
    want = [(k * 3604 + 4 + 3600, "x", "smtp", k * 3604 + 4) for k in range(84) if k * 3604 + 4 < 300_000]
    assert rows_of(got) == sorted(want, key=repr)


def test_concurrent_connections_by_hand(spark):
    at = lambda s: None if s is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice(["smtp", "submission", "pop3"]), s, rng.choice([None, s, s + rng.randrange(9000)]))
            for s in (rng.randrange(20_000) for _ in range(200))]
    rows += [(None, "smtp", 5, None)] * 4 + [("c", "smtp", 0, 10), ("c", "smtp", 10, 20), ("c", "smtp", 20, 30)]
    limits = {"smtp": 2, "submission": 6}
    want = []
    for key in {r[:2] for r in rows if r[1] in limits}:
        own = [r for r in rows if r[:2] == key]
        level = {s: sum(o <= s and (c is None or c > s) for _, _, o, c in own) for s in {r[2] for r in own}}
        over = [s for s, n in level.items() if n > limits[key[1]]]
        if over:
            want.append((*key, min(over), max(level.values())))
    df = spark.createDataFrame([(i, k, at(o), at(c)) for i, k, o, c in rows], "ip string, service string, opened timestamp, closed timestamp")
    df = df.withColumn("opened", F.col("opened"))
    start = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp())
    got = [(r.ip, r.service, r.second - start, r.most) for r in A.concurrent_connections(df, limits).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and (None, "smtp", 5, 4) in got


def test_large_ignore_list_is_searched(spark):
    rng = random.Random(8)
    ips = [f"10.{rng.randrange(40)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(300)]
    ips += ["2001:db8::1", "2001:DB8:7::5", "2001:db9::1", "x", "", None, "300.1.1.1", "::", "255.255.255.255", "0.0.0.0"]
    nets = [f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}/{rng.choice([30, 32])}" for _ in range(99_000)]
    nets += [f"10.{rng.randrange(40)}.{rng.randrange(256)}.0/{rng.choice([20, 24])}" for _ in range(1000)]
    ips += [n.partition("/")[0] for n in rng.sample(nets, 100)]
    nets += ["2001:db8::/33", "::/128", "255.255.255.255"]
    ranges = A.disjoint_ranges(nets)
    assert A.MOST_LITERALS < len(ranges) < len(nets) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    parsed = [ipaddress.ip_network(n, strict=False) for n in nets[-3:]]
    held = {(int(n.network_address) >> 2) for n in (ipaddress.ip_network(t, strict=False) for t in nets[:-3]) if n.prefixlen == 30}
    wide = {p: {int(ipaddress.ip_network(t, strict=False).network_address) >> (32 - p) for t in nets[:-3] if t.endswith(f"/{p}")} for p in (20, 24, 32)}

    def ignored(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return False
        if any(ip in n for n in parsed if n.version == ip.version):
            return True
        return ip.version == 4 and (int(ip) >> 2 in held or any(int(ip) >> (32 - p) in wide[p] for p in wide))

    df = spark.createDataFrame([(ip,) for ip in ips] * 2, "ip string")
    got = [r.ip for r in A.not_ignored(df, nets).collect()]
    assert sorted(got, key=repr) == sorted([ip for ip in ips if ip is None or not ignored(ip)] * 2, key=repr)


def test_stock_jail_names_have_their_rules(spark):
    assert A.KNOWN_JAILS["postfix-sasl"] == A.JAILS["smtp-sasl"] and A.KNOWN_JAILS["roundcube-auth"] == A.JAILS["webmail"]
    rows = [("postfix", "x", i) for i in range(5)] + [("own", "x", 1), (None, "y", 2), (None, "y", 3)]
    fails = spark.createDataFrame(rows, "jail string, ip string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    assert [(r.jail, r.second) for r in A.ban_events(fails).collect()] == [("postfix", 4)]
    assert rows_of(A.unknown_jails(fails)) == sorted([("own", 1), (None, 2)], key=repr)
