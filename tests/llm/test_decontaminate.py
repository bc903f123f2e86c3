from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from mailfleet.llm import decontaminate as D
from mailfleet.llm.queries import QUERIES
from tests.llm.test_exact_pieces import docs_of

WORDS = [f"w{i}" for i in range(400)]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, seed int, _words string")


def words(text):
    return [w.lower() for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def brute(docs, items):
    """Every document, item and shift, by comparing words."""
    out = {}
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            if not b:
                continue
            size = min(13, len(b))
            need = 11 if size == 13 else size - 1 if size >= 7 else size
            for x in range(len(a) - size + 1):
                for y in range(len(b) - size + 1):
                    if sum(p == q for p, q in zip(a[x:x + size], b[y:y + size], strict=True)) >= need:
                        out[d, i] = True
    return set(out)


def test_masks_lose_no_overlap():
    masks = [m for m, _ in D._masks([])]
    for changed in itertools.combinations(range(D.WINDOW), D.WINDOW - D.EQUAL):
        assert any(not set((m + s).tolist()) & set(changed)
                   for m in masks for s in range(D.WINDOW - int(m[-1])))


@pytest.mark.parametrize("n", range(1, 13))
def test_masks_of_short_items_lose_no_overlap(n):
    masks = [set(m.tolist()) for m, whole in D._masks([n]) if whole == n]
    for changed in itertools.combinations(range(n), n - D.needed(n)):
        assert any(m and not m & set(changed) for m in masks)


def test_short_items(spark):
    items = [(1, "one two three four five six seven"), (2, "yes"), (3, "a b c d e f"), (4, "q r")]
    docs = [(1, "x one two three four CHANGED six seven x"), (2, "x one two NOT four CHANGED six seven"), (3, "oh yes yes"), (4, "a b c d e F"), (5, "a b c X e f"),
            (6, "one two three four five six"), (7, "q r " * 30_000), (8, "one X three four five six seven")]
    got = {(r.doc_id, r.item_id): r.first_word for r in D.overlaps(docs_of(spark, docs), items_of(spark, [(*x, 1, "") for x in items])).collect()}
    assert got == {(1, 1): 1, (3, 2): 1, (4, 3): 0, (7, 4): 0, (8, 1): 0}
    kept = D.decontaminated(docs_of(spark, docs), items_of(spark, [(*x, 1, "") for x in items])).collect()
    assert sorted(r.doc_id for r in kept) == [2, 3, 5, 6, 7]


def test_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=k))) for i, k in enumerate([20, 13, 12, 5, 4, 30, 14, 25, 1, 7, 9])]
    items += [(20, None), (21, ""), (22, items[0][1]), (None, items[5][1])]
    docs = []
    for i in range(120):
        text = rng.choices(WORDS, k=rng.randint(0, 60))
        item = words(rng.choice(items)[1])
        for _ in range(rng.randint(0, 5)):
            if item:
                item[rng.randrange(len(item))] = rng.choice(WORDS)
        cut = rng.randint(0, 6)
        at = rng.randint(0, len(text))
        docs.append((i, " ".join(text[:at] + item[cut // 2:len(item) - cut // 3] + text[at:]).upper()))
    docs += [(500, None), (501, ""), (502, "x " * 60_000 + items[0][1]), (3, items[1][1]), (3, items[1][1])]
    found = D.overlaps(docs_of(spark, docs), items_of(spark, [(*x, 1, "a") for x in items])).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(got) == len(found)
    assert got == brute([x for x in docs if x[0] != 502] + [(502, items[0][1])], items)
    for r in found:
        assert 0 <= r.first_word < r.end_word and r.equal_words <= r.end_word - r.first_word


def test_overlap_is_reported_whole():
    doc, item = np.arange(100, dtype=np.uint64), np.r_[np.arange(20, 60), 7, 7].astype(np.uint64)
    assert D.overlap(doc, item, 20) == (20, 60, 40)
    assert D.overlap(doc, item, 21) is None


@pytest.mark.parametrize("docs, items", [([], [(1, "a b c d e f", 1, "")]), ([(1, "a b c d e f")], []), ([(1, None)], [(1, None, 1, "")])])
def test_nothing_to_find(spark, docs, items):
    assert D.overlaps(docs_of(spark, docs), items_of(spark, items)).count() == 0
    assert D.decontaminated(docs_of(spark, docs), items_of(spark, items)).count() == len(docs)


def test_documents_go_by_row(spark):
    item = " ".join(WORDS[:14])
    rows = [(None, "x " + item), (None, "clean"), (None, None), (1, item), (1, "clean too"), (2, item + " y"), (3, "")]
    kept = D.decontaminated(docs_of(spark, rows), items_of(spark, [(1, item, 1, "a")])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(
        [(None, "clean"), (None, None), (1, "clean too"), (3, "")], key=repr)
    assert len(kept[0]) == len(docs_of(spark, rows).columns)


def test_documents(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    # Whole items are planted: a run of five words in common is needed for any overlap.
    runs = {tuple(words(t)[x:x + 5]) for _, t in items for x in range(len(words(t)) - 4)}
    near = [(d, t) for d, t in docs if any(tuple(words(t)[x:x + 5]) in runs for x in range(len(words(t)) - 4))]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, folder).collect()}
    assert got == brute(near, items)
