"""DNS, certificates, keys, health rules on golden rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mailfleet.functions import scalars as S
from mailfleet.operators import health as H
from mailfleet.operators import posture as P
from mailfleet.sources.status import parse_queue_status, parse_status_dump
from tests.compare import rows_of


POLICY = P.DnsPolicy(("sg1.example.com", "us1.example.com"), ("203.0.113.10", "198.51.100.20"))


def decide(offers):
    """One offer at a time: (seq, serial, end, force)."""
    cur, out = None, []
    for seq, serial, end, force in offers:
        if cur and serial == cur[0] and not force:
            out.append((seq, "skip"))
        elif cur and end < cur[1] and not force:
            out.append((seq, "refuse"))
        else:
            cur = (serial, end)
            out.append((seq, "install"))
    return out


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("forced", [None, "force"])
def test_install_decisions(spark, seed, forced):
    rng = random.Random(seed)
    ends = {s: rng.randrange(50) for s in range(12)}
    offers = []
    for seq in range(60):
        serial = rng.randrange(12)
        offers.append((seq, serial, ends[serial], int(forced is not None and rng.random() < 0.15)))
    df = spark.createDataFrame([("l", *o) for o in offers],
                               "lineage string, seq bigint, serial bigint, not_after bigint, force int")
    for chunk in (1, 7, 1000):
        got = P.install_decisions(df, chunk_size=chunk, forced=forced)
        assert rows_of(got, "seq", "decision") == sorted(decide(offers), key=repr)


def test_second_offer_is_a_no_op(spark):
    df = spark.createDataFrame([("l", 1, 7, 90), ("l", 2, 7, 90)], "lineage string, seq int, serial int, not_after int")
    assert rows_of(P.install_decisions(df), "seq", "decision") == [(1, "install"), (2, "skip")]


def test_days_left_truncates(spark):
    as_of = F.lit("2024-02-01").cast("timestamp")
    rows = [(s,) for s in (-86400, -43200, 0, 86399, 10 * 86400, 21 * 86400 - 1, 21 * 86400)]
    df = spark.createDataFrame(rows, "s bigint").withColumn("not_after", F.timestamp_seconds(S.epoch_s(as_of) + F.col("s")))
    df = df.select("*", F.lit("l").alias("lineage"), F.col("s").alias("serial"), F.lit("x").alias("cert_hash"), F.lit("x").alias("key_hash"))
    got = {r.serial: (r.days, r.status) for r in P.cert_posture(df, as_of).collect()}
    assert got == {-86400: (-1, "expired"), -43200: (0, "fail"), 0: (0, "fail"), 86399: (0, "fail"),
                   864000: (10, "warn"), 21 * 86400 - 1: (20, "warn"), 21 * 86400: (21, "ok")}


def test_fcrdns(spark):
    ptr = spark.createDataFrame([("1.1.1.1", "a.org", "A.org."), ("1.1.1.2", "b.org", None), ("1.1.1.3", "c.org", "x.org"),
                                 ("1.1.1.4", "d.org", "d.org")], "ip string, expected string, ptr string")
    fwd = spark.createDataFrame([("a.org", "9.9.9.9"), ("a.org", "1.1.1.1"), ("d.org", "9.9.9.9")], "name string, address string")
    assert rows_of(P.fcrdns(ptr, fwd), "ip", "state") == [
        ("1.1.1.1", "ok"), ("1.1.1.2", "none"), ("1.1.1.3", "mismatch"), ("1.1.1.4", "forward-mismatch")]


def test_signing_keys(spark):
    local = spark.createDataFrame([(z, "s", "ABCDEF") for z in "abcd"], "zone string, selector string, local_key string")
    txt = spark.createDataFrame([("a", "s", '"v=DKIM1; k=rsa; p=ABC" "DEF"'), ("b", "s", "v=DKIM1; k=rsa; p=ABCD"),
                                 ("c", "s", "v=DKIM1; k=rsa; p=XBCDEF")], "zone string, selector string, txt string")
    assert rows_of(P.dkim_match(local, txt), "zone", "state") == [
        ("a", "match"), ("b", "truncated"), ("c", "mismatch"), ("d", "missing")]


def test_spf(spark):
    both = "ip4:203.0.113.10 ip4:198.51.100.20"
    many = " ".join(f"include:i{i}.x" for i in range(9))
    rows = [("a", f"v=spf1 {both} -all"), ("b", f"v=spf1 {both} ~all"), ("c", f"v=spf1 {both} {many} a mx -all"),
            ("d", f"v=spf1 {both} -all"), ("d", "v=spf1 -all"), ("e", "v=spf1 ip4:203.0.113.100 ip4:198.51.100.20 -all")]
    df = spark.createDataFrame([(z, "@", "TXT", t) for z, t in rows], "zone string, name string, type string, target string")
    assert rows_of(P.spf_audit(df, POLICY), "zone", "records", "nodes_authorised", "lookups", "ending", "status") == [
        ("a", 1, 2, 0, "-", "ok"), ("b", 1, 2, 0, "~", "warn"), ("c", 1, 2, 11, "-", "error"),
        ("d", 2, 2, 0, "-", "error"), ("e", 1, 1, 0, "-", "error")]


def test_rotation(spark):
    rows = [("z", "a", "k1", 0, 20, 100), ("z", "a", "k2", 10, 16, 100), ("z", "a", "k3", 12, None, 100)]
    df = spark.createDataFrame(rows, "zone string, node string, selector string, f int, r int, ttl bigint")
    df = df.withColumn("valid_from", F.timestamp_seconds(F.col("f") * 86400)).withColumn(
        "removed_at", F.timestamp_seconds(F.col("r") * 86400))
    assert rows_of(P.rotation_overlap(df), "selector", "overlap_s") == [("k2", 4 * 86400)]


def test_manifest(spark):
    files = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "z", "q")], "bundle int, name string, content string")
    listed = spark.createDataFrame([(1, "a", "x"), (1, "b", "NO"), (2, "a", "x"), (3, "w", "q")], "bundle int, name string, c string")
    got = P.verify_manifest(files, listed.select("bundle", "name", F.sha2("c", 256).alias("sha256")))
    assert rows_of(got, "bundle", "name", "state", "accepted") == [
        (1, "a", "ok", 0), (1, "b", "differs", 0), (2, "a", "ok", 1), (3, "w", "absent", 0), (3, "z", "unlisted", 0)]


QUEUE = """Queued 'sync' requests        0
Queued 'high' requests        501
Queued 'low' requests         -
Queued 'failed' requests      0
Queued 'full resync' requests 2
Waiting 'failed' requests     3
Total number of known users   12
"""
STATUS = """*** 1. row ***
      Slave_IO_Running: Yes
     Slave_SQL_Running: No
 Seconds_Behind_Master: 301
            Last_Errno: 1062
            Last_Error: Duplicate entry: 'x'
"""


def test_status_and_queue_dumps(spark):
    queue = parse_queue_status(spark.createDataFrame([(1, QUEUE)], "sample_id int, dump string"), keep=["sample_id"])
    assert rows_of(queue, "state", "class", "requests") == [
        ("queued", "failed", 0), ("queued", "full resync", 2), ("queued", "high", 501), ("queued", "low", 0),
        ("queued", "sync", 0), ("waiting", "failed", 3)]
    status = parse_status_dump(spark.createDataFrame([(1, "A", STATUS)], "sample_id int, node string, dump string"), keep=["sample_id", "node"])
    row = status.first()
    assert row.Last_Error == "Duplicate entry: 'x'" and row.Gtid_IO_Pos is None
    both = status.join(H.queue_totals(queue, ["sample_id"]), "sample_id")
    assert [r.problem for r in H.replica_problems(both).collect()] == [
        "sql thread stopped", "duplicate key: both nodes wrote the same row", "lag 301s", "queue 503", "3 failed requests"]


def test_bands_are_strict(spark):
    df = spark.createDataFrame([(100, 85), (101, 86), (500, 92), (501, 93)], "queued int, disk_pct int")
    assert rows_of(H.severity_bands(df), "queued", "queue_state", "disk_state") == [
        (100, "ok", "ok"), (101, "warn", "warn"), (500, "warn", "warn"), (501, "error", "error")]


def test_transitions_and_trend(spark):
    rows = [("A", i, i, s, q) for i, (s, q) in enumerate([("ok", 1), ("problem", 2), ("problem", 3), ("ok", 4), ("ok", 2)])]
    df = spark.createDataFrame([*rows, ("B", 9, 9, "problem", 5)], "node string, sample_id int, t int, state string, queued int")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("t") * 3000))
    got = rows_of(H.transitions(df), "node", "sample_id", "before", "state")
    assert got == [("A", 1, "ok", "problem"), ("A", 3, "problem", "ok"), ("B", 9, "ok", "problem")]
    trend = {r.sample_id: (r.streak, r.trend) for r in H.queue_trend(df, 3).where("node = 'A'").collect()}
    assert trend == {0: (0, "steady"), 1: (1, "steady"), 2: (2, "steady"), 3: (3, "growing"), 4: (0, "draining")}


@pytest.mark.parametrize("text,ok", [("1.2.3.4", True), ("256.1.1.1", False), ("1.2.3", False), ("a.b.c.d", False), ("1.2.3.4.5", False)])
def test_ipv4(spark, text, ok):
    row = spark.createDataFrame([(text,)], "t string").select(
        S.is_ipv4("t").alias("v"), S.long_to_ip(S.ip_to_long("t")).alias("back")).first()
    assert row.v == ok and row.back == (text if ok else None) or not ok


def test_cidr(spark):
    row = spark.createDataFrame([("10.77.3.9/16",)], "t string").select(S.cidr_range("t").alias("r")).first().r
    assert (row.lo, row.hi) == S.cidr_bounds("10.77.0.0/16") == (172818432, 172883967)


def test_replica_problems_of_empty_status_tunnel_and_ids(spark):
    ddl = ("sample_id int, node string, Slave_IO_Running string, Slave_SQL_Running string, Seconds_Behind_Master string, Last_Errno string, "
           "queued bigint, failed bigint, handshake_age_s bigint, id_increment int, id_offset int, own_offset int")
    ok = ("Yes", "Yes", "0", "0", 0, 0)
    rows = [(1, "A", None, None, None, None, 0, 0, 0, 2, 1, 1), (2, "A", *ok, 301, 2, 1, 1), (3, "A", *ok, 300, 1, 1, 2),
            (4, "A", *ok, None, None, None, 1), (5, "A", None, "Yes", "0", "0", 0, 0, 5, 2, 2, 2)]
    df = spark.createDataFrame(rows, ddl)
    got = sorted((r.sample_id, r.problem) for r in H.replica_problems(df).collect())
    assert got == [
        (1, "status is empty: nothing is replicated"), (2, "no tunnel handshake for 301s"), (3, "id increment is 1"), (3, "id offset is 1"),
        (4, "id increment is ?"), (4, "id offset is ?"), (5, "io thread stopped")]
    plain = df.drop("handshake_age_s", "id_increment", "id_offset", "own_offset")
    assert {r.sample_id for r in H.replica_problems(plain).collect()} == {1, 5}


@pytest.mark.parametrize("seed", range(3))
def test_failed_guards_refuse_and_change_nothing(spark, seed):
    rng = random.Random(seed)
    ends = {s: rng.randrange(50) for s in range(12)}
    offers = [(q, s, ends[s], int(rng.random() < 0.15), rng.choice([True, True, False, None]), rng.random() < 0.8)
              for q in range(60) for s in [rng.randrange(12)]]
    df = spark.createDataFrame([("l", *o) for o in offers], "lineage string, seq bigint, serial bigint, not_after bigint, force int, bundle_ok boolean, key_ok boolean")
    good = decide([o[:4] for o in offers if o[4] and o[5]])
    want = sorted([*good, *((o[0], "refuse") for o in offers if not (o[4] and o[5]))])
    for chunk in (1, 7, 1000):
        got = P.install_decisions(df, chunk_size=chunk, forced="force", guards=("bundle_ok", "key_ok"))
        assert rows_of(got, "seq", "decision") == sorted(want, key=repr)
        reasons = {r.seq: r.reason for r in got.collect()}
        for seq, _, _, _, bundle, key in offers:
            if not bundle or not key:
                assert reasons[seq] == ("key_ok" if bundle else "bundle_ok")
            else:
                assert reasons[seq] in (None, "expiry")


def test_guards_need_a_manifest_and_a_key(spark):
    offers = spark.createDataFrame([("l", 1, 1, 5, 1, "k", "k"), ("l", 2, 2, 6, 2, "k", "k"), ("l", 3, 3, 7, 3, "k", None), ("l", 4, 4, 8, None, "k", "k")],
                                   "lineage string, seq int, serial int, not_after int, bundle int, cert_hash string, key_hash string")
    files = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x")], "bundle int, name string, content string")
    listed = files.where("bundle <> 2").select("bundle", "name", F.sha2("content", 256).alias("sha256"))
    got = P.guarded_offers(offers, files, listed)
    assert rows_of(got, "seq", "bundle_ok", "key_ok") == [(1, True, True), (2, False, True), (3, True, False), (4, False, True)]


def test_node_names_and_services(spark):
    rows = [("example.com", "us1", "A", "198.51.100.20", 60), ("z.org", "@", "MX", "sg1.example.com", 60), ("z.org", "webmail", "A", "203.0.113.10", 900)]
    df = spark.createDataFrame([(z, n, t, 10, ttl, x) for z, n, t, x, ttl in rows], "zone string, name string, type string, prio int, ttl int, target string")
    got = rows_of(P.dns_posture(df, POLICY), "zone", "finding")
    assert ("example.com", "node name sg1 has no address") in got and ("example.com", "node name us1 has no address") not in got
    assert not [f for z, f in got if z == "z.org" and "node name" in f]
    assert ("z.org", "service name webmail lacks a node address") in got and ("z.org", "ttl of a failover name too long") in got
    probes = spark.createDataFrame([("z.org", 0, 0)], "zone string, tunnel_ok int, public_ok int")
    held = spark.createDataFrame([("z.org", n, "A", "198.51.100.20") for n in ("mail", "webmail", "autoconfig", "admin")], "zone string, name string, type string, target string")
    assert rows_of(P.failover_plan(probes, held, POLICY), "name", "action") == [("admin", "repoint"), ("mail", "delete"), ("webmail", "delete")]
    assert rows_of(P.restore_plan(held, POLICY), "name", "target") == [("mail", "203.0.113.10"), ("webmail", "203.0.113.10")]


@pytest.mark.parametrize("n", [0, 1, 50, 3000, 40000])
def test_merged_distinct(spark, n):
    rows = spark.range(n * 3).select((F.col("id") % n if n else F.col("id")).alias("value"), (F.col("id") % 2).alias("key"),
                                     F.timestamp_seconds((F.col("id") % 40) * 86400).alias("ts"))
    rows = rows.unionByName(rows.limit(1).withColumn("value", F.lit(None).cast("bigint")))
    sketches = P.distinct_sketches(rows, ["key"], "value", "ts")
    day = F.lit("1970-01-11").cast("date")
    for lo, hi in ((None, None), (day, None), (day, F.date_add(day, 9))):
        kept = rows.where(F.lit(True) if lo is None else F.to_date("ts") >= lo).where(F.lit(True) if hi is None else F.to_date("ts") <= hi)
        exact = {r.key: r.n for r in kept.groupBy("key").agg(F.countDistinct("value").alias("n")).collect()}
        got = {r.key: r.estimate for r in P.merged_distinct(sketches, ["key"], lo, hi).collect()}
        assert got.keys() == exact.keys()
        assert all(abs(got[k] - v) <= max(1, v * P.sketch_error()) for k, v in exact.items())


def test_table_functions(spark):
    from mailfleet.functions.tables import register

    register(spark)
    register(spark)
    spark.createDataFrame([(1, " a, ,b,"), (2, ""), (3, None), (4, "v=spf1  ip4:1.2.3.4 -all ")], "k int, t string").createOrReplaceTempView("lists_in_test")
    items = spark.sql("select k, i.position, i.value from lists_in_test, lateral list_items(t) i where k < 4")
    assert rows_of(items, "k", "position", "value") == [(1, 1, "a"), (1, 2, "b")]
    spf = spark.sql("select k, m.* from lists_in_test, lateral spf_mechanisms(t) m")
    assert rows_of(spf, "k", "position", "mechanism") == [(4, 1, "ip4:1.2.3.4"), (4, 2, "-all")]
    spark.catalog.dropTempView("lists_in_test")
