from __future__ import annotations

import random
import re

import duckdb
import pytest

from mailfleet.llm.license import PHRASES, TEMPLATES, license_blocks, license_labels
from mailfleet.llm.queries import ORACLES, QUERIES
from tests.compare import oracle_rows, rows_of

SCHEMA = "doc_id bigint, text string, _text string, labels string, word int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def docs_of(spark, pairs):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in pairs], SCHEMA)


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, phrases=PHRASES, templates=TEMPLATES, threshold=0.8):
    w = words(text)
    base, labels, starts = set(), set(), []
    for label, phrase in phrases:
        p = words(phrase)
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    score, runs = 1.0 if starts else 0.0, []
    for label, template in templates:
        t = words(template)
        own = set(t)
        shares = [len(own & set(w[i:i + len(t)])) / len(own) for i in range(len(w))]
        good = [s >= threshold - 1e-9 for s in shares]
        i = 0
        while i < len(w):
            j = i
            while j < len(w) and good[j]:
                j += 1
            if j > i:
                runs.append((label, i, j - 1, max(shares[i:j])))
            i = j + 1
    labels = base | {r[0] for r in runs}
    score = max([score, *(r[3] for r in runs)])
    first = (min(starts), max(starts)) if starts else (None, None)
    return (len(w), len(starts), *first, ",".join(sorted(base)), ",".join(sorted(labels)), len(runs), score), runs


def mixed_texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = sorted({w for _, t in TEMPLATES for w in words(t)}) + ["é", "naïve", "x", "ß", "zz", "thing"]
    texts = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                out += rng.choices(vocabulary, k=rng.randint(0, 40))
            else:
                cut = words(rng.choice(TEMPLATES)[1])
                out += [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in cut if rng.random() > 0.05]
        texts.append(rng.choice([" ", "\n", "--", ", "]).join(out))
    return texts


ODD = ["", None, "MIT License", "the MİT License", "cc\x00by", "CC-BY CC BY cc_by", "mit" * 3 + " license", "gnu general public\nLICENSE " * 3,
       "Licensed under CC BY-NC 4.0." * 2, "Released under the\n\n* MIT * License", "license " * 50_000 + "apache license", "a" * 3_000_000]


@pytest.mark.parametrize("seed", range(3))
def test_labels_by_brute_force(spark, seed):
    rows = list(enumerate(mixed_texts(seed) + ODD))
    rows += [(None, "mit license"), (3, "mit license"), (3, "mit license")]
    got = sorted((tuple(r) for r in license_labels(docs_of(spark, rows)).collect()), key=repr)
    want = sorted(((i, *brute(t)[0]) for i, t in rows), key=repr)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert all(abs(g[-1] - w[-1]) < 1e-12 for g, w in zip(got, want))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_blocks_by_brute_force(spark, threshold):
    rows = list(enumerate(mixed_texts(11)))
    got = sorted((r.doc_id, r.template, r.first_word, r.last_word, round(r.containment, 9))
                 for r in license_blocks(docs_of(spark, rows), threshold=threshold).collect())
    want = sorted((i, *r[:3], round(r[3], 9)) for i, t in rows for r in brute(t, threshold=threshold)[1])
    assert want and got == want


def test_query_against_sql(spark, folder):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    df = QUERIES["op12_license_scan"](spark, folder)
    columns = sorted(df.columns)
    got = rows_of(df, *columns)
    assert got == oracle_rows(connection, ORACLES["op12_license_scan"], columns)
    assert any(r[columns.index("base_labels")] for r in got)


def test_empty_table_and_bad_settings(spark):
    assert license_labels(docs_of(spark, [])).count() == 0 and license_blocks(docs_of(spark, [])).count() == 0
    for bad in ({"threshold": 0}, {"templates": [("x", " - ")]}):
        with pytest.raises(ValueError):
            license_labels(docs_of(spark, [(1, "a")]), **bad)
    none = license_labels(docs_of(spark, [(1, "mit license")]), phrases=(), templates=()).first()
    assert (none.n_words, none.n_base, none.labels, none.score) == (2, 0, "", 0.0)
