from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from mailfleet.llm.queries import QUERIES
from mailfleet.llm.whiten import COMPONENTS, cross_products, whitened, whole_entries

SCHEMA = "vec_id bigint, embedding array<float>, n int, z string, dims string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, components=COMPONENTS):
    """n, deviations, covariance and whitened rows by exact fractions and numpy."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
              if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dims)]
    centred = [[Fraction(n * x[k] - sums[k], n) for k in range(dims)] for x in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dims)] for i in range(dims)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in usable:
        c = np.array([float(Fraction(n * x[k] - sums[k], n)) for k in range(dims)])
        out[i] = (sum((n * x[k] - sums[k]) ** 2 for k in range(dims)), c @ u / np.sqrt(e))
    return n, e, e / np.trace(cov), out


def check(got, rows):
    n, e, explained, want = brute(rows)
    size = min(COMPONENTS, len(e))
    assert len(got) == size * len(want)
    signs = {}
    for r in got:
        deviation, w = want[r.vec_id]
        assert r.n == n and int(r.deviation) == deviation
        k = r.component - 1
        if abs(w[k]) > 1e-6:
            assert signs.setdefault(k, np.sign(w[k] * r.whitened)) == np.sign(w[k] * r.whitened)
        assert abs(abs(r.whitened) - abs(w[k])) < 1e-8 * max(1, abs(w[k]))
        assert abs(r.explained - explained[k]) < 1e-9 and r.identity_error < 1e-9


def test_query_by_brute_force(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op11_embedding_whitening"](spark, folder).collect(), rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (k + 1) for k in range(5)]) for i in range(80)]
    rows += [(100 + i, list(rows[3][1])) for i in range(40)]  # copies count once
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] + [0.0] * 4), (203, [float("inf")] + [0.0] * 4),
             (204, [300.0, -200.0, 0.0, 1.0, 2.0]), (205, [])]
    got = whitened(vectors_of(spark, rows + [(206, [0.5] * 7)])).collect()
    check(got, [(i, v) for i, v in rows if v != []])
    assert {r.vec_id for r in got} == {*range(80), *range(100, 140), 204}
    ids = [r.vec_id for r in whitened(vectors_of(spark, [(None, [1.0, 2.0]), (None, [2.0, 1.0]), (3, [4.0, 4.0])])).collect()]
    assert sorted(ids, key=repr) == [3, 3, None, None, None, None]


def test_no_variance(spark):
    assert whitened(vectors_of(spark, [])).count() == 0
    assert whitened(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    one = whitened(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in one)
    flat = whitened(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0])])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)}
    assert {abs(r.whitened) for r in flat if r.component == 1} == {1.0}
    # A value that no whole number of 64 bits can hold is no entry.
    assert {r.vec_id for r in whitened(vectors_of(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0])])).collect()} == {2, 3}


@pytest.mark.parametrize("most", [0, 1, 70, 1 << 30, 1 << 60])
def test_planes_against_products(most):
    rng = random.Random(most)
    for rows in (1, 63, 64, 65, 200):
        z = np.array([[rng.randint(-most, most) for _ in range(4)] + [7] for _ in range(rows)], np.int64)
        wide = [[int(v) for v in row] + [1] for row in z]
        want = [[sum(r[i] * r[j] for r in wide) for j in range(6)] for i in range(6)]
        got = cross_products(z)
        assert all(int(got[i, j]) == want[i][j] for i in range(6) for j in range(i, 6))


def test_entries_of_slices():
    column = pa.array([[1.0], None, [0.5, -0.01], [None], [], [float("nan"), 1.0]], pa.list_(pa.float32())).slice(1)
    usable, lengths, z = whole_entries(column)
    assert list(usable) == [1, 3] and list(lengths) == [2, 0] and list(z) == [32, -1]
