from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from mailfleet.llm import attention as A
from mailfleet.llm import lm
from mailfleet.llm import words as W
from mailfleet.llm.queries import QUERIES, tokenizer
from tests.llm.test_decontaminate import words
from tests.llm.test_exact_pieces import docs_of

PATH = tokenizer("byte_bpe_multi_50k.tiktoken")
SIZE, END = 40, 39


def trained(steps=8):
    rng = np.random.default_rng(2)
    lengths = np.array([1, 60, 33, 24, 25, 200, 7])
    ids = rng.integers(0, END, lengths.sum()).astype(np.int32)
    ids[np.cumsum(lengths) - 1] = END
    trainer = A.Trainer(SIZE)
    trainer.train(ids, lengths, END, steps=steps)
    return trainer, ids, lengths


def one_by_one(model, text):
    """The model's sum of logs by its definition, an id at a time."""
    total, inputs = 0.0, [END, *text[:-1].tolist()]
    query, key, value = np.split(model.looks, 3, axis=1)
    for t, target in enumerate(text.tolist()):
        first = max(0, t // A.STEP * A.STEP - A.CONTEXT)
        own = inputs[first:t + 1]
        logits = np.array([query[inputs[t]] @ key[x] + model.near[t - first - j] for j, x in enumerate(own)])
        weight = np.exp(logits - logits.max())
        gathered = weight @ value[own] / weight.sum()
        z = gathered @ model.out + model.own[inputs[t]]
        share = np.exp(z - z.max())
        share /= share.sum()
        every = model.chance.astype(float) @ share
        assert every.sum() == pytest.approx(1, abs=1e-5)
        total += math.log10(every[target])
    return total


def test_windows_score_each_id_once():
    trainer, ids, lengths = trained()
    model = trainer.model()
    got = A.log_chances(model, ids, lengths, END, many=3)
    ends = np.cumsum(lengths)
    for i, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
        assert got[i] == pytest.approx(one_by_one(model, ids[a:b]), rel=1e-4)


def test_what_comes_later_does_not_matter():
    model = trained()[0].model()
    a = np.arange(30, dtype=np.int32)
    b = a.copy()
    b[20:] = 5
    near = A._near_mask(model.near)
    at, text = A.windows(np.array([30]))
    first = [A.shares(model, A.batch_of(x, np.array([30]), at, text, END), near)[0, :21] for x in (a, b)]
    assert np.allclose(*first)


def test_gradients_by_differences():
    trainer, ids, lengths = trained()
    at, text = A.windows(lengths)
    batch = A.batch_of(ids, lengths, at, text, END)
    for name in trainer.w:
        trainer.w[name] = trainer.w[name].astype(np.float64)
    grads, *_ = trainer.gradients(batch)
    rng = np.random.default_rng(3)
    for name, w in trainer.w.items():
        for _ in range(4):
            at_ = tuple(rng.integers(0, n) for n in w.shape)
            if name == "emb":
                at_ = (rng.choice(trainer.rows), at_[1])
            step, was, loss = 1e-3, w[at_], []
            for sign in (1, -1):
                w[at_] = was + sign * step
                loss.append(trainer.gradients(batch)[3])
            w[at_] = was
            own = (np.searchsorted(trainer.rows, at_[0]), at_[1]) if name == "emb" else at_
            assert grads[name][own] == pytest.approx((loss[0] - loss[1]) / (2 * step), abs=2e-4), name


def test_expected_counts_add_up():
    trainer, ids, lengths = trained()
    counts = np.zeros((SIZE, A.SHARES))
    A.expected_counts(trainer.model(), ids, lengths, END, counts, many=2)
    assert np.allclose(counts.sum(1), np.bincount(ids, minlength=SIZE), rtol=1e-3)
    assert A.chances(counts).sum(0) == pytest.approx(np.ones(A.SHARES), abs=1e-4)


def test_capacity():
    model = trained(steps=1)[0].model()
    assert model.own.shape == model.chance.shape == (SIZE, 64) and model.out.shape == (A.DIM, 64)


def test_training_learns_order():
    text = np.tile(np.array([1, 2, 3, 4, 5, 6, 7, 8], np.int32), 60)
    trainer = A.Trainer(SIZE)
    losses = trainer.train(text, np.array([len(text)]), END, steps=300, many=4)
    assert losses[-1] < 0.8 < 1.8 < losses[0]


def test_sequences():
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=lm.ranks_of(PATH), special_tokens={})
    texts = ["The CAT sat\x0bdown", None, "", "É é x" * 5]
    ids, lengths = lm.subwords(PATH, public_tokenizers.PATTERN).sequences(W.words_of(pa.array(texts)))
    want = [[t for w in words(text) for t in library.encode_ordinary(" " + w.replace("É", "É"))] + [50256] for text in texts]
    want[3] = [t for w in ["É", "é", "xÉ", "é", "xÉ", "é", "xÉ", "é", "xÉ", "é", "x"] for t in library.encode_ordinary(" " + w)] + [50256]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def lower(text):
    return [w for w in (text or "").translate({**{c: " " for c in range(9, 14)}, **{c: c + 32 for c in range(65, 91)}}).split(" ") if w]


def base_scores(docs):
    count = Counter()
    for i, text in docs:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*lower(text), None])
    total, kinds = sum(count.values()), len(count)
    return total, [(i, len(lower(t)) + 1, sum(w in count for w in [*lower(t), None]),
                    sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*lower(t), None])) for i, t in docs]


@pytest.mark.parametrize("sent, steps", [(1 << 17, None), (50, 4)])
def test_documents(spark, folder, monkeypatch, sent, steps):
    monkeypatch.setattr(lm, "SENT_WORDS", sent)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    total, want = base_scores(docs)
    scored = QUERIES["op2_lm_scoring"](spark, folder) if steps is None else lm.scored(
        spark.read.parquet(f"{folder}/documents.parquet"), PATH, public_tokenizers.PATTERN, steps=steps)
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == len(docs)
    for i, n, known, base in want:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    # A hundred texts are few to learn from: no worse than a quarter above the word model.
    held = [r for r in got.values() if r.held_out]
    assert steps or sum(r.score for r in held) > 1.25 * sum(r.base_score for r in held)


@pytest.mark.parametrize("steps", [1, 40])
def test_attention_learns_from_every_text(spark, steps):
    """In rounds (1 step is too few for the input) and on the driver (40 are not)."""
    rows = [(i, f"text number {i} has its words") for i in range(900)] + [(900, "the word " * 4000 + "zebra " * 3000)]
    texts = docs_of(spark, rows).select("text").toDF("_text")
    seen = lm.id_counts(texts, PATH, public_tokenizers.PATTERN)
    cut = lm.subwords(PATH, public_tokenizers.PATTERN)
    want = Counter(cut.sequences(W.words_of(pa.array([t for _, t in rows])))[0].tolist())
    assert {i: int(seen[i]) for i in np.flatnonzero(seen)} == want
    model = lm.train_shares(texts, PATH, public_tokenizers.PATTERN, steps=steps)
    for table in (model.looks, model.own):
        assert np.ptp(table[seen == 0], axis=0).max() < 1e-6
        assert (np.abs(table[seen > 0] - table[seen == 0][0]).max(1) > 1e-3).all()
    assert np.isfinite(model.looks).all() and model.chance.astype(float).sum(0) == pytest.approx(np.ones(A.SHARES), abs=1e-3)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "x y"), (None, "x y"), (3, "the word " * 30_000), (4, "twice"), (4, "twice"), (5, "twice z")]
    total, want = base_scores(docs)
    got = lm.scored(docs_of(spark, docs), PATH, public_tokenizers.PATTERN, steps=9).collect()
    key = lambda r: repr((r[0], r[1], round(r[3], 6)))
    assert sorted(key((r.doc_id, r.n_tokens, 0, r.base_score)) for r in got) == sorted(key(x) for x in want)
    assert {r.train_tokens for r in got} == {total} and all(np.isfinite(r.score) for r in got)
    assert lm.scored(docs_of(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_stored_ids_are_the_texts(spark):
    """Learning from ids cut before, stored with their rounds, is learning from the texts."""
    texts = [None, "", "the word " * 3000, *(f"text number {i} has its words" for i in range(40))]
    cut = lm.subwords(PATH, public_tokenizers.PATTERN)
    ids = [cut.sequences(W.words_of(pa.array([t], pa.string())))[0].astype(lm._kind(cut.end)).tobytes() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])
    got = [(x, n, part.num_rows) for (x, n), part in lm._stored(batch, cut.end)]
    want, lengths = cut.sequences(W.words_of(pa.array(texts)))
    assert np.concatenate([x for x, *_ in got]).tolist() == want.tolist()
    assert np.concatenate([n for _, n, _ in got]).tolist() == lengths.tolist() and sum(n for *_, n in got) == len(texts)
    rounds = spark.range(20_000).select(lm.round_of(lm.F.xxhash64("id")).alias("r")).groupBy("r").count().collect()
    share = {r.r: r["count"] / 20_000 * sum(lm.ROUNDS) for r in rounds}
    assert all(abs(share[i] - n) < 0.2 * n for i, n in enumerate(lm.ROUNDS)) and len(share) == len(lm.ROUNDS)
