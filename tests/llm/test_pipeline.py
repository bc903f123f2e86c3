from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from mailfleet.llm import bpe, quality
from mailfleet.llm.queries import tokenizer
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute as overlapping
from tests.llm.test_jaccard import brute as groups


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.learn(docs.select("doc_id", F.col("text").alias("_text")), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in quality.scores(docs, model).where("score >= 0.3").collect()}
    first = {}
    for i in sorted(good):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i] or ""), i)
    single = set(first.values())
    least = groups([(i, rows[i]) for i in single], 5, 80)
    near = {i for i in single if least[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = near - {i for i, _ in overlapping([(i, rows[i]) for i in near], items)}
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(tokenizer("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert len(rows) > len(good) > len(single) >= len(near) >= len(clean) > len(rows) / 2

    kept = docs
    for (_, stage), want in zip(P.STAGES[:-1], [good, single, near, clean], strict=True):
        kept = P.written(stage(spark, kept, folder), "test-stage")
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(want)
    got = {r.doc_id: r for r in P.STAGES[-1][1](spark, kept, folder).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == {i: library.encode_ordinary(rows[i] or "") for i in clean}
    assert all(r.n_tokens == len(r.ids) for r in got.values())
    assert all(r.decoded_sha256 == hashlib.sha256((rows[i] or "").encode()).hexdigest() for i, r in got.items())


def test_run_is_its_stages(spark, folder):
    assert set(P.QUERIES) == {"pipeline", *P.OPERATORS} and P.QUERIES["pipeline"] is P.run
    assert sorted(int(name[2:].split("_")[0]) for name in P.OPERATORS) == list(range(1, 14))
    out = P.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 100


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a  b", None, "s", 4), (3, "a b", "en", None, 3)]])
def test_odd_rows(spark, folder, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, folder), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert P.STAGES[-1][1](spark, docs, folder).count() == docs.count() <= len(rows)
