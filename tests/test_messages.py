"""Store merging, quota, routing, headers, vacation and delivery."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailfleet.operators import messages as M
from mailfleet.sources.logs import parse_mail_events
from mailfleet.sources.records import header_list, parse_headers
from tests.compare import rows_of

STORE = "username string, guid bigint, folder string, vsize bigint, modseq bigint, flags string, expunged int, saved_at timestamp"
ROW = st.tuples(
    st.just("u"), st.integers(0, 6), st.sampled_from(["INBOX", "Junk"]), st.just(10),
    st.integers(1, 4), st.sampled_from(["", "S", "SR"]), st.integers(0, 1),
)


def store(spark, rows):
    one = {r[1]: r for r in rows}
    return spark.createDataFrame(list(one.values()), STORE.rsplit(",", 1)[0]).withColumn(
        "saved_at", F.lit("2024-01-01").cast("timestamp"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(ROW, max_size=6), b=st.lists(ROW, max_size=6))
def test_merge_properties(spark, a, b):
    left, right = store(spark, a), store(spark, b)
    merged = M.merge_stores(left, right)
    body = ["username", "guid", "folder", "modseq", "flags", "expunged"]
    rows = rows_of(merged, *body)
    assert rows == rows_of(M.merge_stores(right, left), *body)
    assert rows == rows_of(M.merge_stores(merged, merged), *body)
    ids = {r[1] for r in a} | {r[1] for r in b}
    assert [r[1] for r in rows] == sorted(ids)
    dead = {r[1] for r in {x[1]: x for x in a}.values() if r[6]} | {
        r[1] for r in {x[1]: x for x in b}.values() if r[6]}
    assert {r[1] for r in rows if r[5]} == dead


def test_absence_is_not_deletion(spark):
    a = store(spark, [("u", 1, "INBOX", 1, 5, "S", 0), ("u", 2, "INBOX", 1, 5, "", 1)])
    b = store(spark, [("u", 2, "INBOX", 1, 9, "S", 0), ("u", 3, "INBOX", 1, 1, "", 0)])
    got = {r.guid: (r.action, r.flags) for r in M.merge_stores(a, b).collect()}
    assert got == {1: ("copy_to_b", "S"), 2: ("expunge", "S"), 3: ("copy_to_a", "")}


def test_quota_crossings_only_upwards(spark):
    rows = [(i, "u@a", 10, "INBOX", i) for i in range(12)] + [(50, "u@a", 500, "Junk", 1)]
    msgs = spark.createDataFrame(rows, "doc_id bigint, username string, vsize bigint, folder string, t bigint")
    msgs = msgs.withColumn("saved_at", F.timestamp_seconds(F.col("t") * 1000))
    box = spark.createDataFrame([("u@a", 100)], "username string, quota bigint")
    for chunk in (100, 5000, 10**6):
        got = rows_of(M.quota_crossings(msgs, box, chunk), "doc_id", "total", "step")
        assert sorted(got) == [(8, 90, 80), (9, 100, 95), (10, 110, 100)]


HEADERS = "Received: from a\n by b\nX-SPAM: no, yes\nreceived: c\nSubject: x: y\n\nX-Spam: Yes\n"


def test_headers_unfold_and_repeat(spark):
    df = spark.createDataFrame([(HEADERS,), (HEADERS.replace("\n", "\r\n"),)], "raw string")
    for row in parse_headers(df).collect():
        assert row.headers == {"received": ["from a by b", "c"], "x-spam": ["no, yes"], "subject": ["x: y"]}
    names = df.select(F.transform(header_list("raw"), lambda h: h["name"]).alias("n")).first().n
    assert names == ["Received", "X-SPAM", "received", "Subject"]


@pytest.mark.parametrize("raw,folder,seen", [
    ("X-Spam: Yes", "Junk", 1),
    ("x-spam: it is YES indeed", "Junk", 1),
    ("X-Spam-Level: **********", "Junk", 1),
    ("X-Spam-Level: *********", "INBOX", 0),
    ("Auto-Submitted: auto-generated (x)\nX-Spam: Yes", "Junk", 1),
    ("Auto-Submitted: Auto-Generated", "Reports", 0),
    ("X-Report-Type: disposition-notification", "Reports", 0),
    ("X-Report-Type: a disposition-notification", "INBOX", 0),
    ("Subject: hi\n X-Spam: Yes", "INBOX", 0),
    ("Subject: hi\n\nX-Spam: Yes", "INBOX", 0),
    ("X-Spam-Not: Yes", "INBOX", 0),
])
def test_routing(spark, raw, folder, seen):
    row = M.route_messages(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (row.folder, row.seen) == (folder, seen)


def test_clean_headers(spark):
    raw = ("Received: from [10.0.0.5] by sg1 with ESMTPSA; id 1\nReceived: from x with ESMTP\n"
           "X-Originating-IP: 1\nUser-Agent: y\nX-Mailer: Postfix 3\nBcc: z@z\nMessage-ID: <a@laptop.local>\nTo: t")
    df = spark.createDataFrame([(1, raw), (0, raw)], "submitted int, raw string")
    ours, theirs = [r.clean.split("\n") for r in M.clean_headers(df, "a.org").collect()]
    assert ours == ["Received: from x with ESMTP", "Message-ID: <a@a.org>", "To: t"]
    assert theirs == [x for x in raw.split("\n") if not x.startswith(("Bcc", "X-Mailer"))]


def test_training_labels(spark):
    moves = [("INBOX", "Junk"), ("Junk", "INBOX"), ("Junk", "Trash"), ("INBOX", "Archive"), ("Trash", "Junk")]
    df = spark.createDataFrame(moves, "from_folder string, to_folder string")
    got = rows_of(M.training_labels(df), "from_folder", "to_folder", "label")
    assert got == [("INBOX", "Junk", "spam"), ("Junk", "INBOX", "ham"), ("Trash", "Junk", "spam")]


def test_classifier_needs_enough(spark):
    docs = spark.createDataFrame([(i, "buy now " * 3 + f"w{i}" if i % 2 else f"hello friend w{i}") for i in range(40)],
                                 "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("is_spam"))
    tokens = M.message_tokens(docs)
    model = M.bayes_train(tokens, labels)
    assert M.bayes_score(tokens, model, labels).where("log_odds is not null").isEmpty()
    got = M.bayes_score(tokens, model, labels, min_learns=20, min_tokens=3).collect()
    assert all((r.log_odds > 0) == (r.doc_id % 2 == 1) for r in got) and len(got) == 40


@pytest.mark.parametrize("interval", [0, 50, 400])
def test_vacation_replies(spark, interval):
    rng = random.Random(interval)
    msgs = sorted({(rng.choice("ab"), rng.randrange(2000)) for _ in range(120)})
    noted = 700
    df = spark.createDataFrame([("V@x", s, t) for s, t in msgs], "rcpt string, sender string, t bigint")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    vac = spark.createDataFrame([("v@x", 1, interval)], "email string, active int, interval_time int")
    vac = vac.withColumn("activefrom", F.timestamp_seconds(F.lit(100))).withColumn(
        "activeuntil", F.timestamp_seconds(F.lit(1900)))
    note = spark.createDataFrame([("v@x", "a")], "on_vacation string, notified string").withColumn(
        "notified_at", F.timestamp_seconds(F.lit(noted)))
    want = []
    for sender in "ab":
        until = None
        for t in sorted(t for s, t in msgs if s == sender and 100 <= t <= 1900):
            if sender == "a" and t >= noted and (interval == 0 or t < noted + interval):
                continue
            if until is None or t >= until:
                until = t + interval if interval else 10**9
                want.append(("v@x", sender, t))
    assert rows_of(M.vacation_replies(df, vac, note), "rcpt", "sender", "second") == sorted(want, key=repr)


def test_delivery_outcomes(spark):
    df = spark.createDataFrame([(1, 0), (2, 119), (3, 120), (4, 14399), (5, 14400), (6, 259199), (7, 259200), (8, None)],
                               "queue_id bigint, delivered_after_s int")
    got = {r.queue_id: (r.warned, r.outcome) for r in M.delivery_outcomes(df).collect()}
    assert got == {1: (0, "delivered"), 2: (0, "delivered"), 3: (0, "delivered"), 4: (0, "delivered"),
                   5: (1, "delivered"), 6: (1, "delivered"), 7: (1, "bounced"), 8: (1, "bounced")}


def test_mail_event_subject_may_hold_commas(spark):
    line = ("imap(u@a.org)<7><s> sg1: expunge: uid=5, box=Sent Items, msgid=<m@x>, size=12, from=a@b, "
            "subject=one, two, box office, flags=(\\Seen)")
    row = parse_mail_events(spark.createDataFrame([(line,)], "line string")).first()
    assert (row.username, row.event, row.uid, row.box, row.subject, row.flags, row.size) == (
        "u@a.org", "expunge", 5, "Sent Items", "one, two, box office", "\\Seen", 12)


def test_duplicate_folders(spark):
    rows = [("u", "Sent"), ("u", "Sent Items"), ("u", "Junk"), ("w", "Sent"), ("w", "Mine")]
    df = spark.createDataFrame(rows, "username string, folder string")
    assert rows_of(M.duplicate_folders(df)) == [(2, "Sent", "u")]
