from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mailfleet.llm import quality, toxicity
from mailfleet.llm import words as W
from mailfleet.llm.queries import QUERIES
from tests.llm.test_exact_pieces import docs_of

ODD = [(1, None), (2, ""), (None, "x"), (3, " \n "), (4, "word " * 50_000), (4, "twice"), (4, "twice")]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string, score string")


@pytest.mark.parametrize("name, label, threshold, least", [
    ("op3_quality", "quality", 0.3, 0.95), ("op5_toxicity", "toxic", 0.5, 0.9)])
def test_held_out_accuracy(spark, folder, name, label, threshold, least):
    folder = folder.replace("sf0.001", "sf0.01")
    want = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    right = []
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id in want:
            right.append(r.predicted == want[r.doc_id])
    assert np.mean(right) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
@pytest.mark.parametrize("labels", [
    [], [(4, 1, 0, None, None)], [(i, j % 2, j % 2, "", "") for j, i in enumerate((None, 1, 2, 3, 4, 4))],
    [(1, None, None, "", "")]], ids=str)
def test_odd_rows(spark, module, labels):
    got = module.classified(docs_of(spark, ODD), labels_of(spark, labels)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in ODD)
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_empty_table(spark, module):
    assert module.classified(docs_of(spark, []), labels_of(spark, [])).count() == 0


def test_batched_scores_are_those_of_the_bag():
    texts = ["one two two", "", None, "Shti Shti Shti!", "é ü | x"]
    model = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32)
    got = quality._scores(pa.array(texts), model, 0.25)
    for text, score in zip(texts, got, strict=True):
        used, share = quality._bag(text or "")
        assert score == pytest.approx(1 / (1 + np.exp(-(share @ model[used] + 0.25))), abs=1e-5)


def score_of(text):
    tagger = toxicity.Tagger(toxicity.Lexicon({"idiot": 4.0, "stemword": 0.0}, {"stem": 3.0}))
    return float(toxicity.features_of(pa.array([text]), tagger)[0, 0])


def test_clauses():
    plain = score_of("what an idiot")
    assert plain == pytest.approx(4.0)
    assert score_of("you idiot") > plain > score_of("he's... not an idiot") > 0
    assert score_of("they said an idiot did it") < score_of("they saw an idiot do it")
    assert score_of("I will kill you") > 0 and score_of("I will kill. you") == 0
    assert score_of("not here, an idiot") == pytest.approx(plain)  # the comma ends the negation
    assert score_of("not here\nan idiot") == pytest.approx(plain)
    assert score_of("IDIOT!!!") == pytest.approx(4.0) and score_of("idiotic") == 0
    assert score_of("stemming") == pytest.approx(3.0) and score_of("stemword stem") == pytest.approx(3.0)


def in_turn(tags):
    """The five machines one after another over one clause, each reading what the one before put out."""
    total, symbols = 1.0, list(tags)
    for machine in toxicity.MACHINES:
        state, put_out = 0, []
        for symbol, weight in symbols:
            put_out.append((int(machine.out[state, symbol]), weight * machine.weight[state, symbol]))
            state = machine.next[state, symbol]
        total, symbols = total * machine.final[state], put_out
    return total * sum(w for s, w in symbols if s >= toxicity.MATCH)


def by_rule(tags):
    """A clause's score by the rules, from what stands before each match."""
    total, kinds = 0.0, [k for k, _ in tags]
    for i, (kind, weight) in enumerate(tags):
        threats = [j for j in range(max(0, i - toxicity.THREAT_SPAN), i) if kinds[j] == toxicity.THREAT]
        if kind == toxicity.TARGET and threats and toxicity.TARGET not in kinds[threats[-1]:i]:
            weight = toxicity.THREAT_WEIGHT
        elif kind != toxicity.INSULT:
            continue
        if toxicity.NEGATION in kinds[max(0, i - toxicity.NEGATION_SPAN):i]:
            weight *= toxicity.NEGATED
        if toxicity.REPORT in kinds[:i]:
            weight *= toxicity.REPORTED
        total += weight
    return total * (toxicity.TARGETED if toxicity.TARGET in kinds else 1)


def clauses_of(rng, n, longest):
    out = []
    for _ in range(n):
        kinds = rng.choice(6, rng.integers(1, longest), p=[.4, .15, .1, .05, .15, .15]).tolist()
        out.append([(k, float(rng.integers(1, 9)) if k == toxicity.INSULT else 1.0) for k in kinds])
    return [c for c in out if any(k for k, _ in c)]


@pytest.mark.parametrize("seed, n, longest", [(1, 400, 12), (2, 9, 400), (3, 60, 40), (4, 1, 3000)])
def test_composed_machine_is_the_five_in_turn(seed, n, longest):
    clauses = clauses_of(np.random.default_rng(seed), n, longest)
    kind, weight, gap, length = [], [], [], []
    for tags in clauses:
        tagged = [i for i, (k, _) in enumerate(tags) if k]
        kind += [tags[i][0] for i in tagged]
        weight += [tags[i][1] for i in tagged]
        # What stands before a clause's first tag changes nothing.
        gap += [0, *(j - i - 1 for i, j in zip(tagged, tagged[1:], strict=False))]
        length.append(len(tagged))
    got = toxicity.clause_scores(*map(np.array, (kind, weight, gap, length)))
    assert got == pytest.approx([in_turn(c) for c in clauses])
    assert got == pytest.approx([by_rule(c) for c in clauses])


def test_composition_is_associative():
    left, machines = toxicity.composed(), list(toxicity.MACHINES)
    right = machines.pop()
    while machines:
        right = toxicity.compose(machines.pop(), right)
    assert len(left.final) == len(right.final) <= 5 * 4 * 2 * 2
    for tags in clauses_of(np.random.default_rng(7), 50, 30):
        ends = []
        for machine in (left, right):
            state, total = 0, 0.0
            for kind, weight in tags:
                total += weight * machine.weight[state, kind] * (machine.out[state, kind] >= toxicity.MATCH)
                state = machine.next[state, kind]
            ends.append(total * machine.final[state])
        assert ends[0] == pytest.approx(ends[1])


def test_features_by_brute_force():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "stemword": 0.0, "notable": 2.5, "you": 0.0}, {"stem": 3.0, "stemm": 1.5, "no": 0.5})
    bag = ["idiot", "IDIOT!", "stem", "stemming", "stemword", "notable", "nobody", "you", "your.", "kill", "hurt,", "not", "said", "plain",
           "x|", "idiot-you", "ünd", "42", "a\nb", "\n", "never\n", "\u00a0"]
    fixed = toxicity.Tagger.FIXED
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(bag, rng.integers(0, 60))) for _ in range(300)] + [None, "", " ".join(["you idiot."] * 200), "idiot " * 5000]

    def tag(word):
        best = (toxicity.NONE, 1.0)
        for part in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", word.lower()):
            weight = lexicon.words.get(part, max((w for s, w in lexicon.stems.items() if part.startswith(s)), default=0.0))
            if weight and (best[0] != toxicity.INSULT or weight > best[1]):
                best = (toxicity.INSULT, weight)
            elif best[0] == toxicity.NONE:
                best = (fixed.get(part, toxicity.NONE), 1.0)
        return best

    got = toxicity.features_of(pa.array(texts), toxicity.Tagger(lexicon))
    for text, row in zip(texts, got, strict=True):
        own = []
        for line in (text or "").split("\n"):
            clause = []
            for word in re.split("[ \t-\r]+", line) + [".", ]:
                clause.append(tag(word))
                if word and word[-1] in ".!?;:,|":
                    own.append(by_rule(clause))
                    clause = []
        own = [s for s in own if s > 0]
        assert row.tolist() == pytest.approx([sum(own), max(own, default=0), len(own)])
    assert got[-2, 2] == 200


def test_words_of_a_column():
    texts = ["a  B\tc", None, "", " x\x0by z\x85w ", "A", "end\n"] * 3
    found = W.words_of(pa.array(texts)[1:])
    words = [found.data[s:e].tobytes().decode() for s, e in zip(found.start, found.end, strict=True)]
    want = [(i, w) for i, t in enumerate(texts[1:])
            for w in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    assert list(zip(found.text.tolist(), words, strict=True)) == want
    by_word = {}
    for h, w in zip(found.hash.tolist(), words, strict=True):
        assert by_word.setdefault(w.lower(), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_texts_hash_alike(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(20_000))
    whole = W.words_of(pa.array([text])).hash
    monkeypatch.setattr(W, "BLOCK", 64)
    assert (W.words_of(pa.array([text])).hash == whole).all() and len(set(whole.tolist())) == 977
