from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

from mailfleet.llm.exact import exact_groups, without_copies
from mailfleet.llm.pieces import Automaton, token_counts, vocabulary
from mailfleet.llm.queries import tokenizer

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("_text", T.StringType()), T.StructField("_bytes", T.LongType()),
    T.StructField("kept", T.StringType()),
])


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in pairs], DOCS)


PAIRS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (None, "a b"), (None, "only null"),
    (7, "long " * 40_000), (6, "long\n" * 40_000), (8, "long " * 39_999 + "lonk "),
    (11, "x\x85y"), (12, "x y"), (13, "twice"), (13, "twice"),
]


def test_groups_by_brute_force(spark):
    import re

    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in PAIRS]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep))
    got = [tuple(r)[:4] for r in exact_groups(docs_of(spark, PAIRS)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_digests_are_whole_texts(spark):
    import hashlib

    row = exact_groups(docs_of(spark, [(1, "a \n b")]), all_digests=True).first()
    assert row.text_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert exact_groups(docs_of(spark, [(1, "a \n b")])).first().text_sha256 is None


def test_kept_rows_keep_their_columns(spark):
    kept = without_copies(docs_of(spark, PAIRS))
    assert kept.columns == DOCS.fieldNames()
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 6, 8, 9, 11, 12, 13, 13]


def test_copies_go_by_row(spark):
    rows = [(1, "a"), (2, "a "), (2, "b"), (None, "a"), (None, "own"), (None, None), (3, "c")]
    kept = without_copies(docs_of(spark, rows)).collect()
    want = [(1, "a"), (2, "b"), (None, "own"), (None, None), (3, "c"), (2, "a ")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(want, key=repr)
    kept = without_copies(docs_of(spark, [(1, "a"), (2, "a"), (2, "b"), (None, "a"), (None, "own"), (4, None), (None, "")])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, "a"), (2, "b"), (None, "own"), (4, None)], key=repr)


def test_empty_tables(spark):
    assert exact_groups(docs_of(spark, [])).count() == 0
    assert token_counts(docs_of(spark, []), tokenizer("piece_bpe_32k.model")).count() == 0


def greedy(pieces, longest, word):
    tokens = 0
    while word:
        for k in range(min(longest, len(word)), 0, -1):
            if word[:k] in pieces:
                tokens, word = tokens + 1, word[k:]
                break
        else:
            tokens, word = tokens + len(word[0].encode()), word[1:]
    return tokens


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_cutting(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choices("abcé", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 30))}
    automaton = Automaton(sorted(pieces))
    for _ in range(400):
        word = "".join(rng.choices("abcé€", k=rng.randint(0, 14)))
        assert automaton.count(word) == greedy(pieces, 6, word), (pieces, word)


def test_counts_of_documents(spark, folder):
    path = tokenizer("piece_bpe_32k.model")
    pieces = set(vocabulary(path))
    longest = max(map(len, pieces))
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    texts += [(900_001, None), (900_002, " \n"), (900_003, "€😀 \x85 x" * 3), (None, "a" * 100_000)]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(docs_of(spark, texts), path).collect()}
    for i, text in texts:
        words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        assert got[i] == (len(words), sum(greedy(pieces, longest, "▁" + w) for w in words)), i
