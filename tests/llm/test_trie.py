from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from mailfleet.llm import trie
from mailfleet.llm.queries import ORACLES, QUERIES
from tests.compare import oracle_rows, rows_of

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, h1 string, bytes int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def turn_hash(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """The trie by walking it, conversation by conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or ""))
    for conv in own:
        own[conv] = [t[1:] for t in sorted(
            own[conv], key=lambda t: (t[0] is not None, t[0] or 0, turn_hash(*t[1:])))]
    members = defaultdict(list)
    ends = defaultdict(list)
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        path = own.get(base, [])[:h] + own[conv][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
        ends[tuple(path)].append(conv)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves = 0 if kids[node] else 1
        for k in kids[node]:
            saved, leaves = saved + below[k][0], leaves + below[k][1]
        below[node] = saved, leaves
    return sorted((
        (min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), below[n][1], below[n][0],
         hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n in members), key=repr)


def got(spark, rows):
    return sorted((tuple(r) for r in trie.conversation_trie(turns_of(spark, rows)).select(*COLUMNS).collect()), key=repr)


def sample(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-40, 400), convs):
        for k in range(rng.choice([1, 2, 3, 5, 9, 12])):
            turn = rng.choice([k, k, k, None, rng.randint(0, 3)])
            rows.append((conv, turn, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é", "", None, "ab", "long " * 9])))
    rows += [rng.choice(rows) for _ in range(20)]  # repeated rows
    rows += [(None, 0, "user", "a"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed,chunk", [(0, 4096), (1, 2), (2, 3)])
def test_by_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = sample(seed)
    assert got(spark, rows) == brute(rows)


def test_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BITS", 4)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 1000, 5) for t in range(3)]
    rows += [(7000, t, "user", f"turn {t}") for t in range(9000)]
    rows += [(7005, t, "user", f"turn {t}") for t in range(8999)] + [(7005, 9001, "user", "x" * 2_000_000)]
    assert got(spark, rows) == brute(rows)


def test_odd_tables(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "user", "a")]) == []
    # Without its base, a conversation of few turns keeps none; it is a member of the root.
    short = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    for rows in ([(short, 0, "user", "a")], [(short, 0, "user", "a"), (5000, 0, "user", "a")], [(5000, None, None, None)] * 2):
        assert got(spark, rows) == brute(rows)
    assert got(spark, [(short, 0, "user", "a")])[0][:6] == (short, 0, None, 1, 0, 1)


def test_query_against_sql(spark, folder):
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    df = QUERIES["op13_conversation_trie"](spark, folder)
    columns = sorted(df.columns)
    assert columns == sorted(COLUMNS)
    assert rows_of(df, *columns) == oracle_rows(connection, ORACLES["op13_conversation_trie"], columns)
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert got(spark, rows) == brute(rows)
