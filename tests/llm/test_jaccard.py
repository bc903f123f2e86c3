from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from mailfleet.llm import jaccard
from mailfleet.llm.bloom import Filter
from mailfleet.llm.graph import components
from mailfleet.llm.jaccard import neighbour_keys, neighbour_starts, one_of_each_group, similar_groups, small_sets, unshared
from tests.llm.test_decontaminate import words
from tests.llm.test_exact_pieces import docs_of


def token_set(text, size):
    w = words(text)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    """Least id reachable, by comparing all sets."""
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(token_set(text, size))
    ids = sorted(sets)
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= percent * len(s | t):
                        p, q = sorted((root(a), root(b)))
                        least[q] = p
    return {i: root(i) for i in ids}


def corpus(seed):
    """Near copies of few texts, boilerplate that many share, chains, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = [rng.choices(vocabulary, k=40) for _ in range(2)]
    bases = [rng.choices(vocabulary, k=rng.choice([4, 12, 30, 60, 150])) for _ in range(10)]
    rows = []
    for i in range(260):
        text = list(rng.choice(bases[:3] if i % 3 == 0 else bases)) if i % 5 else rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 4)):
            if text:
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if i % 4 == 0:
            text += rng.choice(common)
        rows.append((rng.randrange(10**6), " ".join(text).title()))
    return rows + [(10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "one"), (10**6 + 4, "ONE"), (10**6 + 5, "a b"), (10**6 + 6, "b a")]


@pytest.mark.parametrize("seed, size, percent, frequent", [(1, 3, 90, 32), (2, 3, 90, 3), (3, 5, 80, 2), (4, 2, 60, 8), (5, 1, 90, 1)])
def test_against_all_pairs(spark, seed, size, percent, frequent):
    rows = corpus(seed)
    got = similar_groups(docs_of(spark, rows).repartition(3), size=size, percent=percent, frequent=frequent).collect()
    want = brute(rows, size, percent)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(token_set(t, size)) for i, t in rows}
    assert len(set(want.values())) < len(want) - 20


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, long), (9, long + " more"), (None, long), (None, "no other"), (7, "x y z"), (7, "x y z"), (None, None), (8, " ")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_groups(docs_of(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, 29_998, 5), (9, 29_999, 5), (None, 29_998, 5), (None, 1, None), (7, 1, 7), (7, 1, 7), (None, 0, None), (8, 0, 8)], key=repr)
    kept = one_of_each_group(docs_of(spark, rows))
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [5, 7, 7, 8, None, None, None]))


def test_empty_table(spark):
    assert similar_groups(docs_of(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)]
    edges += [(3000, x) for x in range(3001, 3050)] + [(5, 5), (None, 3), (4, None)]
    least = {}

    def root(i):
        while least.setdefault(i, i) != i:
            i = least[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            p, q = sorted((root(a), root(b)))
            least[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: root(i) for i in least}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_near_copies_go_by_row(spark):
    """Several texts under one id stand for themselves."""
    text = " ".join(f"w{i}" for i in range(60))
    near, other = text + " end", " ".join(f"v{i}" for i in range(60))
    rows = [(1, text), (2, near), (2, other), (2, near), (6, other + " x"), (None, near + " more"), (3, ""), (4, None), (5, near), (5, near)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, _row int, _doc string")
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    # Of the other text and its near copy the one with a plain id stays.
    want = [(1, text), (6, other + " x"), (None, near + " more"), (3, ""), (4, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert one_of_each_group(docs.limit(0)).count() == 0


def sorted_set(tokens, frequent):
    """A set as the index sees it: text, token and frequent arrays, rare tokens first."""
    h = np.array(sorted(tokens, key=lambda x: (x in frequent, x)), np.uint64)
    return np.zeros(len(h), int), h, np.array([int(x) in frequent for x in h], bool), np.array([len(h)])


@pytest.mark.parametrize("percent", [55, 60, 80, 90, 99])
def test_neighbours_reach_every_similar_pair(percent):
    """Two larger sets that share frequent tokens only have a pair of neighbours in common."""
    rng = random.Random(percent)
    found = 0
    for _ in range(4000):
        n = rng.randint(int(small_sets(percent) * percent / 100), 260)
        shared = rng.sample(range(1, 4000), n)
        # What differs may lie before everything shared, where it pushes the shared tokens back, or right between them.
        spare = n * (100 - percent) // percent
        a = rng.choice([0, spare, rng.randint(0, spare)])
        b = spare - a if rng.random() < .7 else rng.randint(0, spare - a)
        low = rng.random() < .5
        extra = rng.sample(range(10_000, 20_000) if low else range(4000, 8000), a + b)
        x, y = set(shared) | set(extra[:a]), set(shared) | set(extra[a:])
        if low:
            shift = {t: i for i, t in enumerate(sorted(extra))}
            x, y = ({shift.get(t, t + 20_000) for t in s} for s in (x, y))
        rare = set(rng.sample(sorted(x ^ y), rng.randint(0, len(x ^ y)))) if rng.random() < .3 else set()
        if max(len(x), len(y)) <= small_sets(percent) or 100 * len(x & y) < percent * len(x | y):
            continue
        frequent = (x | y) - rare
        mine, theirs = (set(neighbour_keys(*sorted_set(s, frequent), percent)[1].tolist()) for s in (x, y))
        assert mine & theirs
        assert len(mine) < 2 * len(x)
        found += 1
    assert found > 500


def test_keys_of_a_long_text_of_frequent_tokens_are_linear():
    h = np.arange(1, 100_001, dtype=np.uint64)
    text, keys = neighbour_keys(np.zeros(len(h), int), h, np.ones(len(h), bool), np.array([len(h)]), 80)
    assert len(keys) == len(text) == 2 * 20_000 + 1


def test_near_copies_of_a_long_text(spark):
    """All tokens are frequent; two groups of copies stay apart, and a text with too many changes stands alone."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    rows = []
    for i in range(40):
        text = list(base)
        for _ in range(rng.randint(1, 300)):
            text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    far = list(base)
    for at in range(0, len(far), 10):
        far[at] = f"v{at}"
    rows.append((100, " ".join(far)))
    got = {r.doc_id: r.component_id for r in similar_groups(docs_of(spark, rows).repartition(4), size=5, percent=80).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 100: 100}


def test_places_of_first_shared_neighbours_exclude_no_similar_pair(spark):
    """The first key that two similar sets share leaves enough tokens behind it in both."""
    rng = random.Random(7)
    percent, pairs = 80, []
    for _ in range(1500):
        n = rng.randint(70, 200)
        pool = rng.sample(range(1, 100_000), n + n // 4)
        shared, extra = set(pool[:n]), pool[n:n + n * (100 - percent) // percent]
        cut = rng.randint(0, len(extra))
        x, y = shared | set(extra[:cut]), shared | set(extra[cut:])
        if rng.random() < .5:  # what differs comes first
            low = {t: i for i, t in enumerate(sorted(extra))}
            x, y = ({low.get(t, t + 200_000) for t in s} for s in (x, y))
        rare = set(rng.sample(sorted(x ^ y), rng.randint(0, len(x ^ y))))
        places = []
        for s in (x, y):
            text, h, frequent, size = sorted_set(s, (x | y) - rare)
            at = neighbour_starts(text, frequent, size, percent)
            places.append((dict(zip(neighbour_keys(text, h, frequent, size, percent)[1].tolist(), at.tolist())), int((~frequent).sum())))
        (mine, r), (theirs, q) = places
        key = min(mine.keys() & theirs.keys(), key=mine.get)
        pairs.append((len(x), len(y), (mine[key] << 32) | r, (theirs[key] << 32) | q))
    rows = spark.createDataFrame(pairs, "na bigint, nb bigint, pa bigint, pb bigint")
    a, b = (F.col(n) - unshared(F.col(p), F.col(q)) for n, p, q in (("na", "pa", "pb"), ("nb", "pb", "pa")))
    enough = (100 + percent) * F.least(a, b) >= percent * (F.col("na") + F.col("nb"))
    assert rows.where(enough).count() == len(pairs)
    assert rows.where((F.col("pa") != F.col("pb")) & (unshared(F.col("pa"), F.col("pb")) > F.col("pa").bitwiseAND(0xFFFFFFFF))).count() > 10


def test_many_changed_copies_make_few_pairs(spark, monkeypatch):
    """Copies that are near their base, and as many that are too far from it and from one another."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 301):
        text = list(base)
        for at in rng.sample(range(0, 150, 5), 1 + 3 * (i % 2)):
            text[at] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(text)))
    made, keep = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, purpose, *more: made.append((purpose, keep(df, purpose, *more))) or made[-1][1])
    got = {r.doc_id: r.component_id for r in similar_groups(docs_of(spark, rows)).collect()}
    assert got == brute(rows, 3, 90) and len(set(got.values())) > 140
    star, rest = (df.count() for purpose, df in made if purpose == "pairs")
    assert star < 20 * len(rows) and rest < 5 * len(rows)


def test_memory_of_a_task(monkeypatch):
    """Tables beside the shingles do not grow with the batch; once they took an executor over its memory."""
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 5000, 600).tolist())) for _ in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "_text": texts})

    class Sent:
        value = Filter(np.full(1 << 18, 0x9249249249249249, np.uint64), 24)

    monkeypatch.setattr(jaccard, "_BLOCK_BYTES", jaccard._BLOCK_BYTES // 8)
    for run, most in ((jaccard._signatures(5), 40), (jaccard._blocks(5, 16), 60), (jaccard._keys(5, 80, Sent), 40), (jaccard._sets(5, Sent), 40)):
        tracemalloc.start()
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1] / (1 << 20)
        tracemalloc.stop()
        assert peak < most, (run, peak)


def test_counts_of_blocks():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 9, 40).tolist())) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"_text": texts})
    table = pa.Table.from_batches(list(jaccard._blocks(3, 7)(iter([batch, batch]))))
    got = []
    for block in range(7):
        got += jaccard._frequent_in_block(table.filter(pc.equal(table["block"], block)), 20)["token"].to_pylist()
    count = Counter((jaccard.shingles(pa.array(texts), 3)[1] >> np.uint64(32)).tolist())
    assert got == sorted(t for t, n in count.items() if 2 * n >= 20) and len(got) > 100


def test_memory_of_a_counted_block():
    """Blocks of four million tokens once took a worker over the executors' memory."""
    tokens = 85_000_000
    span = (1 << 32) // jaccard.blocks_of(tokens)
    n = tokens // jaccard.blocks_of(tokens) // 8
    rng = np.random.default_rng(2)
    parts = [np.unique(rng.integers(0, span, n, dtype=np.uint32)) for _ in range(8)]
    counts = [jaccard.zlib.compress(np.ones(len(p), np.uint32).tobytes(), 1) for p in parts]
    table = pa.table({"tokens": pa.array([jaccard._squeezed(p) for p in parts]), "counts": pa.array(counts)})
    tracemalloc.start()
    got = jaccard._frequent_in_block(table, 2)["token"].to_numpy()
    peak = tracemalloc.get_traced_memory()[1] / (1 << 20)
    tracemalloc.stop()
    kinds, came = np.unique(np.concatenate(parts), return_counts=True)
    assert (got == kinds[came > 1]).all() and len(got)
    assert peak < 48, peak
