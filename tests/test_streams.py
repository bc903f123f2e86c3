"""Streams in many triggers, and across a restart, give what their batch form gives."""

from __future__ import annotations

import datetime
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from mailfleet.catalog import QUERIES
from mailfleet.catalog.abuse import WIDE, fails
from mailfleet.catalog.health import states
from mailfleet.operators import abuse as A
from mailfleet.operators import health as H
from mailfleet.operators import messages as M
from mailfleet.sources.fixtures import Views
from mailfleet.sources.schema import conform
from mailfleet.streaming import jobs, runs, store
from mailfleet.streaming.processors import ROCKSDB
from mailfleet.streaming.runs import CLOSING, StreamViews, last_update, replayed, run_available, run_closed
from tests.compare import rows_of

ORDER = {"events": "ts", "orders": "o_orderdate", "documents": "doc_id"}
PARTS = 4


def put(table, order, target, name, stamp):
    os.makedirs(target, exist_ok=True)
    path = f"{target}/{name}.parquet"
    pq.write_table(table, path)
    os.utime(path, (stamp, stamp))


@pytest.fixture(scope="module")
def parted(folder, tmp_path_factory):
    """The data with events, orders and documents in several files, in time order."""
    root = tmp_path_factory.mktemp("parts")
    for name in os.listdir(folder):
        table = name.removesuffix(".parquet")
        if table not in ORDER:
            os.symlink(f"{folder}/{name}", root / name)
            continue
        data = pq.read_table(f"{folder}/{name}").sort_by(ORDER[table])
        size = -(-len(data) // PARTS)
        for i in range(PARTS):
            put(data.slice(i * size, size), ORDER[table], root / name, f"part{i}", 1_700_000_000 + i)
    return str(root)


@pytest.fixture
def live(spark, parted):
    return lambda *tables: StreamViews(spark, parted, tables, files_per_batch=1)


def test_bans(spark, folder, live):
    views = Views(spark, folder)
    rule = {name: A.Jail(2, "3d", j.bantime) for name, j in WIDE.items()}
    batch = A.ban_ledger(fails(views), rule)
    source = live("events")("fx_auth").where("outcome = 'fail'").select("jail", "ip", "ts")
    end = {"jail": sorted(rule)[0], "ip": "closing", "ts": CLOSING}
    got = run_closed(lambda f: jobs.ban_stream(f, rule), [source], [end], "bans")
    assert got.select("batch_id").distinct().count() > 1
    assert rows_of(got.drop("batch_id")) == rows_of(batch) != []


@pytest.mark.parametrize("seed", range(2))
def test_bans_do_not_depend_on_the_order_of_arrival(spark, tmp_path, seed):
    """Rows shuffled within the watermark, some without a source; and three rows that only look
    like a run when the middle one comes last."""
    rng = random.Random(seed)
    rule = {"smtp": A.Jail(3, "60s", "200s")}
    rows = [("x", 1100), ("x", 1101), ("x", 1000)]
    rows += [(rng.choice(["y", "z", None]), rng.randrange(2000, 4000)) for _ in range(160)]
    come = sorted(rows, key=lambda r: r[1] + (150 if r[1] == 1000 else rng.randrange(140)))
    ddl = "jail string, ip string, ts timestamp"
    frame = lambda part: spark.createDataFrame(
        [("smtp", ip, datetime.datetime.fromtimestamp(t, datetime.UTC).replace(tzinfo=None)) for ip, t in part], ddl)
    for i in range(0, len(come), 12):
        put(pa.Table.from_batches(frame(come[i:i + 12]).toArrow().to_batches()), None, tmp_path / "in", f"p{i:04}", 1_700_000_000 + i)
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    end = {"jail": "smtp", "ip": "closing", "ts": CLOSING}
    got = run_closed(lambda f: jobs.ban_stream(f, rule), [source], [end], "late")
    want = rows_of(A.ban_ledger(frame(rows), rule))
    assert rows_of(got.where("ip is distinct from 'closing'").drop("batch_id")) == want
    assert any(r[1] is None for r in want) or any(None in r for r in want)


def test_replaced_trigger_counts_a_ban_once(spark, tmp_path):
    """The folder of a trigger is written again; its bans are read twice."""
    ddl = "jail string, ip string, start bigint, end bigint"
    first = [("smtp", "x", 1000, 2000), ("admin", "x", 1000, 2000), ("smtp", "y", 1000, 2000)]
    second = [("smtp", "x", 3000, 4000), ("smtp", "y", 3000, 4000), ("smtp", "z", 3000, 4000)]
    for i, part in enumerate([first, second, first, second]):
        put(pa.Table.from_batches(spark.createDataFrame(part, ddl).toArrow().to_batches()), None, tmp_path / "in", f"p{i}", 1_700_000_000 + i)
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    end = {"jail": "smtp", "ip": "closing", "start": int(CLOSING.timestamp()), "end": 0}
    got = run_closed(lambda b: jobs.recidive_stream(b, A.Jail(3, "1d", "7d"), watermark="2 hours"), [source], [end], "again")
    assert [(r.ip, r.start) for r in got.where("ip <> 'closing'").collect()] == [("x", 3000)]


def test_ignored_sources_are_not_banned(spark, live):
    rule = {name: A.Jail(1, "1d", "1h") for name in WIDE}
    source = live("events")("fx_auth").where("outcome = 'fail'").select("jail", "ip", "ts")
    end = {"jail": sorted(rule)[0], "ip": "198.51.100.9", "ts": CLOSING}
    got = run_closed(
        lambda f: jobs.ban_stream(f, rule, ignore=["203.0.113.0/30"]), [source], [end], "ignored")
    assert not got.isEmpty()
    assert got.where(A.in_ranges("ip", ["203.0.113.0/30"])).isEmpty()


def shuffled(spark, tmp_path, ddl, rows, at, seed, per_file=9, late=200):
    """A stream of rows in small files, each up to ``late`` seconds out of order."""
    rng = random.Random(seed)
    come = sorted(rows, key=lambda r: r[at] + datetime.timedelta(seconds=rng.randrange(late)))
    for i in range(0, len(come), per_file):
        part = spark.createDataFrame(come[i:i + per_file], ddl)
        put(pa.Table.from_batches(part.toArrow().to_batches()), None, tmp_path / "in", f"p{i:04}", 1_700_000_000 + i)
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))


def moment(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


SAMPLES = "node string, sample_id bigint, ts timestamp, state string"
ALERT_END = {"node": "closing", "sample_id": -1, "ts": CLOSING, "state": "ok"}


@pytest.mark.parametrize("seed", range(2))
def test_alerts_do_not_depend_on_the_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [("C", 1, moment(1000), "ok"), ("C", 3, moment(1100), "ok"), ("C", 2, moment(1050), "problem")]
    rows += [(rng.choice("AB"), 100 + i, moment(rng.randrange(3000)), rng.choice(["ok", "problem"])) for i in range(60)]
    source = shuffled(spark, tmp_path, SAMPLES, rows, 2, seed)
    got = run_closed(jobs.alert_stream, [source], [ALERT_END], "alerts", settings=ROCKSDB).where("node <> 'closing'")
    want = H.transitions(spark.createDataFrame(rows, SAMPLES))
    columns = "node", "sample_id", "before", "state"
    assert got.select("batch_id").distinct().count() > 1
    assert rows_of(got, *columns) == rows_of(want, *columns)


def test_alert_sink_sends_each_change_once(spark, folder, live, tmp_path):
    sent, path = [], str(tmp_path / "alerts")
    kept = run_closed(
        jobs.alert_stream, [states(live("events"))], [ALERT_END], "alerts", settings=ROCKSDB, path=path,
        write=store.alert_writer(path, send=lambda df, batch: sent.append((batch, df.count()))))
    batch = H.transitions(states(Views(spark, folder)))
    assert sum(n for _, n in sent) == kept.count() == batch.count() and len({b for b, _ in sent}) == len(sent)
    assert max(n for _, n in sent) < kept.count()


def test_windows(spark, folder, live):
    samples = Views(spark, folder)("fx_sample").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run_available(jobs.watchdog_stream(live("events")("fx_sample")), "windows", "update")
    assert rows_of(last_update(got, ["start", "node"])) == rows_of(H.watchdog_windows(samples))


MESSAGES = "rcpt string, sender string, ts timestamp"


@pytest.mark.parametrize("seed", range(2))
def test_vacation_replies_by_event_time(spark, tmp_path, seed):
    """Shuffled files, replies recorded before, intervals with and without an end, and nothing left in the state."""
    rng = random.Random(seed)
    away = [(f"u{i}@d", 1, moment(0), moment(2500 if i % 2 else 10**8), [0, 300, 700][i % 3]) for i in range(6)]
    vacation = spark.createDataFrame(
        [*away, ("off@d", 0, moment(0), moment(10**8), 60)],
        "email string, active int, activefrom timestamp, activeuntil timestamp, interval_time int")
    notified = spark.createDataFrame(
        [("U0@d", "s0", moment(-50)), ("u1@d", "s1", moment(900)), ("u1@d", "s1", moment(100)), ("u3@d", "s2", moment(1500)),
         ("off@d", "s0", moment(5)), ("nobody@d", "s0", moment(5))], "on_vacation string, notified string, notified_at timestamp")
    rows = [(rng.choice([*[e for e, *_ in away], "off@d", "other@d"]), f"s{rng.randrange(3)}", moment(rng.randrange(4000))) for _ in range(160)]
    progress = str(tmp_path / "progress")
    source = shuffled(spark, tmp_path, MESSAGES, rows, 2, seed)
    end = {"rcpt": "closing", "sender": "closing", "ts": CLOSING}
    got = run_closed(
        lambda m: jobs.vacation_stream(m, vacation, notified), [source], [end], "vacation", settings=ROCKSDB, checkpoint=progress)
    want = M.vacation_replies(spark.createDataFrame(rows, MESSAGES), vacation, notified)
    assert got.select("batch_id").distinct().count() > 1
    assert rows_of(got.drop("batch_id")) == rows_of(want) != []
    for name in ("waiting", "memory"):
        assert spark.read.format("statestore").option("stateVarName", name).load(progress).isEmpty()


def test_vacation_without_earlier_replies(spark, folder, live):
    views = Views(spark, folder)
    vacation = conform(views("fx_vacation"), "vacation")
    nobody = views("fx_notified").where("false")
    batch = M.vacation_replies(views("fx_vacation_msg"), vacation, nobody)
    end = {"msg_id": -1, "ts": CLOSING, "rcpt": "closing", "sender": "closing"}
    got = run_closed(
        lambda m: jobs.vacation_stream(m, vacation), [live("events")("fx_vacation_msg")], [end], "vacation", settings=ROCKSDB)
    assert rows_of(got.drop("batch_id")) == rows_of(batch)


def test_named_sessions_end_after_a_quiet_day(spark, tmp_path):
    ddl = "event_id bigint, ts timestamp, username string, session_id string"
    day = 86400
    rows = [(i, moment(t), "u", s) for i, (t, s) in enumerate([
        (0, "a"), (100, "a"), (100 + day, "a"), (99 + 2 * day, "a"), (50, ""), (1849, ""), (3649, ""), (200, "b"), (200 + 3 * day, "b")])]
    source = shuffled(spark, tmp_path, ddl, rows, 1, 0, per_file=2)
    end = {"event_id": -1, "ts": CLOSING, "username": "closing", "session_id": ""}
    got = run_closed(jobs.sessions_stream, [source], [end], "named").where("username <> 'closing'")
    events = spark.createDataFrame(rows, ddl)
    want = rows_of(M.sessionize(events, named_gap_s=day))
    assert rows_of(got.drop("batch_id")) == want and len(want) == 6
    assert M.sessionize(events).where("session_id <> ''").count() == 2


def test_sessions(spark, folder, live):
    views = Views(spark, folder)
    cut = F.unix_seconds(F.lit("2024-01-27").cast("timestamp"))
    batch = M.sessionize(views("fx_session"), 14400).where(F.col("end") < cut)
    got = run_available(jobs.sessions_stream(live("events")("fx_session"), 14400), "sessions")
    assert rows_of(got.drop("batch_id").where(F.col("end") < cut)) == rows_of(batch)


def test_delivery(spark, folder, live):
    views = Views(spark, folder)
    streams = live("orders")
    queued = streams.sql("select queue_id, queued_at as ts from fx_delivery")
    done = streams.sql(
        "select queue_id, queued_at + interval '1' hour * delivered_after_h as ts "
        "from fx_delivery where delivered_after_h is not null")
    got = run_available(jobs.delivery_stream(queued, done), "delivery").drop("batch_id")
    early = views("fx_delivery").where("queued_at < timestamp '2001-01-01'").select("queue_id")
    outcomes = M.delivery_outcomes(
        views("fx_delivery").select("queue_id", (F.col("delivered_after_h") * 3600).alias("delivered_after_s")))
    want = outcomes.join(early, "queue_id")
    ended = got.where("outcome <> 'warned'").select("queue_id", "outcome")
    assert rows_of(ended.join(early, "queue_id")) == rows_of(want.select("queue_id", "outcome"))
    warned = got.where("outcome = 'warned'").select("queue_id").join(early, "queue_id")
    assert rows_of(warned) == rows_of(want.where("warned = 1").select("queue_id"))


class _StateRows(StreamingQueryListener):
    """Rows of state after each trigger, and the runs that have ended."""

    def __init__(self):
        self.rows, self.ended = [], 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += [s.numRowsTotal for s in event.progress.stateOperators]

    def onQueryTerminated(self, event):
        self.ended += 1


def _outcomes(orders):
    """Warnings, deliveries and bounces of ``orders`` (id, time), pair by pair."""
    hour = datetime.timedelta(hours=1)
    queued = [(i, at) for i, at in orders if i is not None and at is not None]
    done = {}
    for i, at in queued:
        if i % 9:
            done.setdefault(i, []).append(at + i % 80 * hour)
    for i, at in queued:
        second = int(at.replace(tzinfo=datetime.UTC).timestamp())
        found = [d for d in done.get(i, []) if at <= d < at + 72 * hour]
        yield from ((i, "delivered", int(d.replace(tzinfo=datetime.UTC).timestamp())) for d in found)
        if not found:
            yield i, "bounced", second + 72 * 3600
        if not any(d < at + 4 * hour for d in found):
            yield i, "warned", second + 4 * 3600


def test_a_backlog_of_deliveries_does_not_wait_in_state(spark, tmp_path, monkeypatch):
    """Orders of 60 days in no order, some twice or again after a day, some without an id or a time."""
    rng, day = random.Random(9), datetime.timedelta(days=1)
    begin = datetime.datetime(2024, 1, 1)
    orders = [(i, begin + rng.randrange(60 * 24) * day / 24) for i in range(3000)]
    orders += orders[:100] + [(i, at + day) for i, at in orders[100:200]]
    orders += [(None, at) for _, at in orders[:20]] + [(3000 + i, None) for i in range(20)]
    rng.shuffle(orders)
    pq.write_table(
        pa.table({"o_orderkey": pa.array([i for i, _ in orders], pa.int64()),
                  "o_orderdate": pa.array([at for _, at in orders], pa.timestamp("us"))}),
        tmp_path / "orders.parquet")
    monkeypatch.setattr(runs, "REPLAYED_ROWS", 600, raising=False)
    state = _StateRows()
    spark.streams.addListener(state)
    try:
        got = QUERIES["str09_delivery_stream"](spark, str(tmp_path))
        for _ in range(300):
            if state.ended == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(state)
    assert rows_of(got, "queue_id", "outcome", "second") == sorted(_outcomes(orders), key=repr)
    assert 0 < max(state.rows) < 2000  # of 5,900 that a join takes in


def test_a_replay_brings_every_row_in_the_order_of_time(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(9)]), rng.choice([None, *range(200)])) for _ in range(2000)]
    rows += [(1, 77)] * 300
    made = spark.createDataFrame(rows, "k int, t int").select("k", F.timestamp_seconds("t").alias("at"))
    monkeypatch.setattr(runs, "REPLAYED_ROWS", 400)
    first, second = replayed([made.where("k < 5"), made.where("k is null or k >= 5")], "at", "two")
    both = first.withColumn("which", F.lit(1)).unionByName(second.withColumn("which", F.lit(2)))
    got = run_available(both, "two")
    assert rows_of(got.select("k", "at")) == rows_of(made)
    assert got.where("(which = 1) <> coalesce(k < 5, false)").isEmpty()
    spans = got.groupBy("batch_id").agg(F.min("at"), F.max("at"), F.count("*")).orderBy("batch_id").collect()
    assert len(spans) > 3 and max(s[3] for s in spans) < 1200
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert got.where("at is null and batch_id > 1").isEmpty()


def test_message_state(spark, folder, live, tmp_path):
    views = Views(spark, folder)
    msg = views("fx_msg")
    merged = M.merge_stores(msg.where("node = 'A'"), msg.where("node = 'B'"))
    state = store.message_state_stream(live("documents")("fx_msg"), str(tmp_path / "state"))
    body = ["username", "guid", "modseq", "flags", "folder", "expunged"]
    assert rows_of(state, *body) == rows_of(merged, *body)
    assert store.reconcile(msg.where("node = 'A'"), msg.where("node = 'B'"), state).isEmpty()


CHANGES = "username string, guid bigint, modseq bigint, flags string, folder string, expunged int"


def trigger(spark, root, number, rows):
    store._newest(spark.createDataFrame(rows, CHANGES)).write.mode("overwrite").parquet(f"{root}/batch_id={number}")


def changes_of(seed, triggers=6):
    """Changes of some messages, repeats and tombstones among them, and a user that is null."""
    rng = random.Random(seed)
    return [[(rng.choice(["ann", "bob", None]), rng.randrange(12), rng.randrange(50), rng.choice(["", "S", "SR"]), "INBOX",
              int(rng.random() < 0.1)) for _ in range(15)] for _ in range(triggers)]


def read_folders(df):
    return {part for f in df.inputFiles() for part in f.split("/") if part.startswith("batch_id=") or part[:12].isdigit()}


@pytest.mark.parametrize("fails_at", ["point", "drop"])
def test_state_survives_an_end_inside_compaction(spark, tmp_path, monkeypatch, fails_at):
    root, parts = str(tmp_path / "state"), changes_of(3)
    whole = lambda n: rows_of(store._newest(spark.createDataFrame(sum(parts[:n], []), CHANGES)))
    state = lambda: rows_of(store.message_state(spark, root))
    for i in (0, 1, 2):
        trigger(spark, root, i, parts[i])
    assert state() == whole(3)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store._Place, fails_at, stop)
        with pytest.raises(KeyboardInterrupt):
            store.compact(spark, root)
    switched = fails_at == "drop"
    assert state() == whole(3)
    assert any(f.startswith("batch_id") for f in read_folders(store.message_state(spark, root))) != switched
    trigger(spark, root, 2, parts[2])  # the stream starts again with its last trigger
    trigger(spark, root, 3, parts[3])
    assert state() == whole(4)
    assert store.compact(spark, root) == 3
    assert state() == whole(4) and len(read_folders(store.message_state(spark, root))) == 1
    trigger(spark, root, 4, parts[4])
    assert state() == whole(5)
    assert {f for f in read_folders(store.message_state(spark, root)) if f.startswith("batch_id")} == {"batch_id=4"}
    assert store.compact(spark, root) == 4 == store.compact(spark, root)
    assert state() == whole(5)
    # The generation before is still there for readers that began with it, nothing older.
    left = sorted(os.listdir(root))
    assert "batch_id=0" not in left and "batch_id=3" not in left and len(os.listdir(f"{root}/base")) <= 2


def test_readers_keep_the_state_they_began_with(spark, tmp_path):
    root, parts = str(tmp_path / "state"), changes_of(4)
    for i in (0, 1):
        trigger(spark, root, i, parts[i])
    store.compact(spark, root)
    trigger(spark, root, 2, parts[2])
    begun = store.message_state(spark, root)
    want = rows_of(store._newest(spark.createDataFrame(sum(parts[:3], []), CHANGES)))
    store.compact(spark, root)
    assert rows_of(begun) == want


def test_stream_compacts_as_it_goes(spark, folder, live, tmp_path):
    views = Views(spark, folder)
    msg = views("fx_msg")
    merged = M.merge_stores(msg.where("node = 'A'"), msg.where("node = 'B'"))
    root = str(tmp_path / "state")
    state = store.message_state_stream(live("documents")("fx_msg"), root, compact_every=3)
    body = ["username", "guid", "modseq", "flags", "folder", "expunged"]
    assert rows_of(state, *body) == rows_of(merged, *body)
    assert len([f for f in read_folders(state) if f.startswith("batch_id")]) == PARTS - 3
    with pytest.raises(FileNotFoundError):
        store.message_state(spark, str(tmp_path / "nothing"))


def test_restart_keeps_state(spark, folder, tmp_path):
    """Half of the input, a stop, then the rest with the same progress folder."""
    data = pq.read_table(f"{folder}/events.parquet").sort_by("ts")
    half, root = len(data) // 2, tmp_path / "data"
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    rule = {name: A.Jail(2, "3d", j.bantime) for name, j in WIDE.items()}

    def run():
        source = StreamViews(spark, str(root), ["events"])("fx_auth").where("outcome = 'fail'")
        return run_available(jobs.ban_stream(source.select("jail", "ip", "ts"), rule), "bans",
                             path=out, checkpoint=progress)

    put(data.slice(0, half), "ts", root / "events.parquet", "a", 1_700_000_000)
    first = run().count()
    put(data.slice(half), "ts", root / "events.parquet", "b", 1_700_000_100)
    got = run()
    want = A.ban_ledger(fails(Views(spark, folder)), rule)
    assert 0 < first < got.count()
    assert rows_of(got.drop("batch_id")) == rows_of(want)


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from mailfleet.plans import session

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake(), "x")
