"""Replica comparison, checksums and writing rules."""

from __future__ import annotations

import hashlib

import pytest

from pyspark.sql import functions as F

from mailfleet.operators import replicas as R
from tests.compare import rows_of


def test_parity_golden(spark):
    rows = [(15, "A"), (16, "B"), (17, "A"), (18, "B")]
    df = spark.createDataFrame(rows, "id bigint, node string")
    got = rows_of(R.parity_report(df, {"A": 1, "B": 2}), "node", "parity", "ids", "violation")
    assert got == [("A", 1, 2, 0), ("B", 0, 2, 0)]
    bad = spark.createDataFrame([*rows, (20, "A")], "id bigint, node string")
    assert R.parity_report(bad, {"A": 1, "B": 2}).where("violation = 1").count() == 1
    three = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (6, "C")], "id bigint, node string")
    assert R.parity_report(three, {"A": 1, "B": 2, "C": 3}, ring=3).where("violation = 1").count() == 0


def test_diff_sees_nulls(spark):
    ddl = "k string, v string, w int, id int"
    a = spark.createDataFrame([("1", None, 1, 1), ("2", "", 1, 2), ("3", "x", None, 3), ("4", "y", 1, 4)], ddl)
    b = spark.createDataFrame([("1", None, 1, 9), ("2", None, 1, 8), ("3", "x", 0, 3), ("5", "y", 1, 4)], ddl)
    got = rows_of(R.replica_diff(a, b, ["k"], ignore=["id"]), "k", "state")
    assert got == [("1", "equal"), ("2", "changed"), ("3", "changed"), ("4", "only_a"), ("5", "only_b")]


def test_node_local_tables_are_left_out():
    assert set(R.replicated_tables({"mailbox": 1, "quota2": 2, "quota": 3, "session": 4})) == {"mailbox"}


def test_checksum(spark):
    """Equal sets agree whatever their order, and one changed key shows."""
    names = [f"user{i}@a.org" for i in range(500)]
    a = spark.createDataFrame([("g", n) for n in names], "d string, u string")
    same = spark.createDataFrame([("g", n) for n in reversed(names)], "d string, u string").repartition(3)
    other = a.where("u <> 'user7@a.org'").union(spark.createDataFrame([("g", "zz")], "d string, u string"))
    sums = [R.ordered_checksum(x, ["d"], "u").first() for x in (a, same, other)]
    assert sums[0] == sums[1] and sums[0].checksum != sums[2].checksum
    parts = [[int(hashlib.md5(n.encode()).hexdigest()[8 * i:8 * i + 8], 16) for n in names] for i in range(4)]
    whole = ":".join(map(str, [len(names), *map(sum, parts)]))
    assert sums[0].checksum == hashlib.md5(whole.encode()).hexdigest()


def test_set_checksum_ignores_order(spark):
    a = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    b = a.orderBy(F.col("k").desc())
    assert R.set_checksum(a, "k").first() == R.set_checksum(b, "k").first()
    assert R.set_checksum(a, "k").first() != R.set_checksum(a.where("k <> '3'"), "k").first()


def test_insert_twice_is_once(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    once = old.unionByName(R.insert_if_absent(new, old, ["k"]))
    assert rows_of(once, "k", "v") == [("a", 1), ("b", 2)]
    assert R.insert_if_absent(new, once, ["k"]).isEmpty()


def test_changed_only_keeps_the_previous_hash(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "k string, v string")
    got = {r.k: (r.action, r.previous is None) for r in R.changed_only(new, old, ["k"]).collect()}
    assert got == {"b": ("replace", False), "c": ("create", True)}


def test_update_by_key(spark):
    target = spark.createDataFrame([("a", "x", 0), ("b", "y", 0)], "u string, p string, modified int")
    changes = spark.createDataFrame(
        [("a", "n1", 5), ("a", "n2", 7), ("ghost", "z", 9)], "u string, p string, at int")
    got = rows_of(R.update_by_key(target, changes, "u", ["p"], "at", ["at"]), "u", "p", "modified")
    assert got == [("a", "n2", 7), ("b", "y", 0)]


def test_pages_join_up(spark):
    df = spark.createDataFrame([(f"u{i:03d}",) for i in range(120)], "u string")
    seen, after = [], None
    while rows := [r.u for r in R.page(df, "u", after).collect()]:
        seen += rows
        after = rows[-1]
    assert seen == sorted(seen) and len(seen) == 120


def test_marker_lag(spark):
    sent = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "marker string, t int")
    seen = spark.createDataFrame([("a", 200), ("a", 900), ("b", 20_001)], "marker string, t int")

    def at(df):
        return df.withColumn("ts", F.timestamp_millis("t")).drop("t")

    got = rows_of(R.marker_lag(at(sent), at(seen)), "marker", "lag_ms", "state")
    assert got == [("a", 200, "ok"), ("b", 20_001, "late"), ("c", None, "missing")]


def test_earlier_row_stays(spark):
    ddl = "k string, v string, created int"
    a = spark.createDataFrame([("1", "a", 5), ("2", "a", 5), ("3", "a", 5), ("4", "s", 1)], ddl)
    b = spark.createDataFrame([("1", "b", 6), ("2", "b", 4), ("3", "b", 5), ("4", "s", 1)], ddl)
    found = R.propose_resolution(R.key_collisions(a, b, ["k"], "natural"))
    assert rows_of(found, "k", "keep", "repair_on") == [("1", "A", "B"), ("2", "B", "A"), ("3", "A", "B")]


LOG = "k string, v string, w bigint"


def log_of(spark, n=6000):
    return [(None if i == 7 else f"k{i}", None if i % 11 == 0 else f"v{i % 50}", i) for i in range(n)]


@pytest.fixture
def compared(monkeypatch):
    """How many rows reach the comparison by key."""
    seen, plain = [], R.replica_diff
    monkeypatch.setattr(R, "replica_diff", lambda a, b, *rest: seen.append((a.count(), b.count())) or plain(a, b, *rest))
    return seen


def test_equal_replicas_are_compared_without_their_rows(spark, compared):
    rows = log_of(spark)
    a, b = spark.createDataFrame(rows, LOG), spark.createDataFrame(rows[::-1], LOG)
    assert R.replica_changes(a, b, ["k"], bits=6).isEmpty() and compared == [(0, 0)]
    nothing = spark.createDataFrame([], LOG)
    assert R.replica_changes(nothing, nothing, ["k"]).isEmpty()


@pytest.mark.parametrize("bits,levels,most", [(6, 2, 60), (6, 1, 1500), (1, 3, 12_000)])
def test_digest_tree_finds_what_the_full_comparison_finds(spark, compared, bits, levels, most):
    rows = log_of(spark)
    changed = [*rows[:3], ("k3", "other", 3), ("k4", None, 4), *rows[6:], ("new", "x", 1), (None, "another null", 9), rows[20]]
    a, b = spark.createDataFrame(rows, LOG), spark.createDataFrame(changed, LOG)
    want = rows_of(R.replica_diff(a, b, ["k"]).where("state <> 'equal'"))
    compared.clear()
    assert rows_of(R.replica_changes(a, b, ["k"], bits=bits, levels=levels)) == want and len(want) >= 4
    assert max(compared[0]) <= most
    ignored = R.replica_changes(a, b, ["k"], ["w"], bits=bits, levels=levels)
    assert rows_of(ignored) == rows_of(R.replica_diff(a, b, ["k"], ["w"]).where("state <> 'equal'"))


def test_a_row_with_a_null_key_is_appended_once(spark):
    have = spark.createDataFrame([("a", 1, "x")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 1, "y"), (None, 1, "y"), (None, 1, "x"), ("a", None, "z")], "k string, n int, v string")
    first = R.insert_if_absent(new, have, ["k", "n"])
    assert rows_of(first, "k", "n", "v") == sorted([(None, 1, "x"), ("a", None, "z")], key=repr)
    assert R.insert_if_absent(new, have.union(first), ["k", "n"]).isEmpty()
