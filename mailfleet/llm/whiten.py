"""Whitening of embeddings from exact integer cross-products.

Entries become whole numbers (``floor(scale * c)``). Of the distinct vectors, each dimension is shifted to
start at zero in a batch and cut into bit planes, which are packed across the batch's rows into 64-bit
words: the cross-product of two dimensions is the sum of popcounts of the AND of their planes, weighted
by powers of two. Shifts are undone in whole numbers, so sums over tasks are exact, whatever their order.
The scatter is centred in whole numbers too, and only then divided and handed to ``eigh``.

Sums come to the driver as one number for two dimensions, so their size depends on the dimensions alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailfleet.llm.shared import written

SCALE, COMPONENTS = 64, 16
_LIMIT = 1 << 62
_SUMS = "i int, j int, limb int, v bigint"


def whole_entries(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that can be used, their lengths, and their entries ``floor(scale * c)`` one after the other.

    A row is left out if it is null, if an entry is null or not finite, or if ``scale * c`` is beyond 2**62.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    null = np.asarray(column.is_null())
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale
    row = np.repeat(np.arange(len(lengths)), lengths)
    with np.errstate(invalid="ignore"):
        wrong = ~(np.abs(values) < _LIMIT)
    bad = null | (np.bincount(row[wrong], minlength=len(lengths)) > 0)
    return np.flatnonzero(~bad), lengths[~bad], np.floor(values[~bad[row]]).astype(np.int64)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of non-negative columns: words, and for each plane its column and its power of two."""
    rows = len(y)
    bits = np.array([int(m).bit_length() for m in y.max(axis=0)])
    words = -(-rows // 64)
    of = np.repeat(np.arange(y.shape[1]), bits)
    power = np.concatenate([np.arange(b) for b in bits]) if len(of) else np.zeros(0, np.int64)
    packed = np.zeros((len(of), words * 8), np.uint8)
    for a in range(int(bits.max(initial=0))):
        at = np.flatnonzero(power == a)
        packed[at, :-(-rows // 8)] = np.packbits((y[:, of[at]] >> a & 1).astype(bool), axis=0).T
    return packed.view(np.uint64), of, power


def cross_products(z: np.ndarray) -> np.ndarray:
    """Exact ``sum of z_i * z_j`` for the columns of ``z`` and a last column of ones (upper half, Python ints)."""
    rows, width = z.shape
    low = np.append(z.min(axis=0), 0)
    y = np.column_stack([z - low[:-1], np.ones(rows, np.int64)])
    planes, of, power = bit_planes(y)
    held = np.unique(of)
    start = np.searchsorted(of, held)
    # Whole numbers of 64 bits do while no weighted sum can leave them.
    small = 2 * int(power.max()) + 2 + int(rows).bit_length() < 62
    weight = np.array([1 << int(a) for a in power], np.int64 if small else object)
    total = np.zeros((width + 1, width + 1), object)
    for k, i in enumerate(held):
        first, last = start[k], start[k + 1] if k + 1 < len(held) else len(of)
        sums = 0
        for p in range(first, last):
            both = np.bitwise_count(planes[p] & planes[first:]).sum(axis=1, dtype=np.int64)
            sums = sums + weight[p] * (both if small else both.astype(object))
        total[i, held[k:]] = np.add.reduceat(sums * weight[first:], start[k:] - first)
    shift = low.astype(object)
    of_y = total[:, width].copy()
    return total + np.outer(of_y, shift) + np.outer(shift, of_y) + int(rows) * np.outer(shift, shift)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    limb = 0
    while not -(1 << 31) <= value < 1 << 31:
        yield limb, value & 0xFFFFFFFF
        value, limb = value >> 32, limb + 1
    yield limb, value


def _scatter(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1), object)
        for batch in batches:
            if batch.num_rows:
                z = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, dims)
                total = total + cross_products(z)
        out = [(i, j, *limb) for i in range(dims + 1) for j in range(i, dims + 1) for limb in _limbs(int(total[i, j]))]
        i, j, limb, v = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(limb, pa.int32()), pa.array(v, pa.int64())],
            ["i", "j", "limb", "v"])
    return run


class Whitening:
    """What whitens a vector: counts and sums (whole numbers), unit axes, their variances and shares."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, components: int) -> None:
        self.n, self.dims = n, len(sums)
        centred = n * products - np.outer(np.array(sums, object), np.array(sums, object))
        # One division of whole numbers gives the nearest double.
        cov = np.array([[int(c) / (n * n) for c in row] for row in centred], np.float64).reshape(self.dims, self.dims)
        e, u = np.linalg.eigh(cov)
        order = np.argsort(-e, kind="stable")[:components]
        trace = sum(int(centred[i, i]) for i in range(self.dims)) / (n * n)
        self.e, self.u = np.maximum(e[order], 0.0), u[:, order]
        self.varied = self.e > self.dims * np.finfo(float).eps * max(self.e.max(initial=0.0), 0.0)
        self.explained = self.e / trace if trace else np.full(len(order), np.nan)
        self.scaled = self.u / np.sqrt(np.where(self.varied, self.e, np.nan))
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened vectors; NaN on an axis without variance."""
        return ((z - self.whole) - self.part) @ self.scaled

    def deviation(self, z: np.ndarray) -> list[int]:
        """``sum of (n*z - sum)**2`` of each vector, exact."""
        a, n = z - self.whole, self.n
        most = int(np.abs(a).max(initial=0))
        fits = most * max(most, n) * self.dims < _LIMIT
        a, rest = (a, np.array(self.rest, np.int64)) if fits else (a.astype(object), np.array(self.rest, object))
        squares, mixed = (a * a).sum(axis=1).astype(object), (a * rest).sum(axis=1).astype(object)
        return list(squares * (n * n) - mixed * (2 * n) + sum(r * r for r in self.rest))


def _identity(model: Whitening):
    size = len(model.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, model.dims)
                w = np.column_stack([np.nan_to_num(model.project(z)), np.ones(len(z))])
                total += w.T @ w
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])
    return run


def _fit(fit: DataFrame, dims: int, components: int) -> tuple[Whitening, float]:
    own = fit.where(F.col("dims") == dims).select("z")
    products, sums = np.zeros((dims + 1, dims + 1), object), None
    for r in own.mapInArrow(_scatter(dims), _SUMS).groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).toLocalIterator():
        products[r.i, r.j] += r.v << 32 * r.limb
    products = np.triu(products) + np.triu(products, 1).T
    sums = [int(s) for s in products[:dims, dims]]
    model = Whitening(int(products[dims, dims]), sums, products[:dims, :dims], components)
    size = len(model.e)
    moments = np.zeros((size + 1, size + 1))
    for r in own.mapInArrow(_identity(model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        moments[r.i, r.j] = r.v
    moments /= model.n
    off = moments[:size, :size] - np.outer(moments[:size, size], moments[:size, size]) - np.eye(size)
    off = off[np.ix_(model.varied, model.varied)]
    return model, float(np.abs(off).max(initial=0.0))


def whitened(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE,
) -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained, identity_error``: each usable row on the first axes.

    Rows are left out if the vector is null, holds null or non-finite entries, or entries beyond 2**62 / ``scale``.
    Each distinct vector counts once in what is learned. Vectors of several lengths: the length with the most distinct vectors is the space
    (the longer one of equals), rows of other lengths are left out. Null and repeated ids are rows like others.
    ``deviation`` is a decimal of 38 digits, null beyond. An axis without variance has null as ``whitened`` and
    does not count in ``identity_error``; without any variance ``explained`` is null. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"))
    id_type = rows.schema["_id"].dataType.simpleString()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths, z = whole_entries(batch.column(0), scale)
            cuts = np.concatenate([[0], np.cumsum(lengths)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths, pa.int32()), pa.array([z[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                ["dims", "z"])

    fit = written(rows.select("_v").mapInArrow(entries, "dims int, z binary").distinct(), "whiten-fit")
    lengths = fit.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    schema = f"`{id_col}` {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if lengths is None or not lengths.dims:
        return spark.createDataFrame([], schema)
    dims = lengths.dims
    model, error = _fit(fit, dims, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.e)
        for batch in batches:
            usable, lengths, z = whole_entries(batch.column(1), scale)
            z = z[np.repeat(lengths == dims, lengths)].reshape(-1, dims)
            usable = usable[lengths == dims]
            w = model.project(z).ravel()
            deviation = [Decimal(d) if d < 10 ** 38 else None for d in model.deviation(z)]
            each = pa.array(np.repeat(np.arange(len(usable)), size))
            many = size * len(usable)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(usable)).take(each),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(usable))),
                pa.array(np.full(many, model.n, np.int64)),
                pa.array(deviation, pa.decimal128(38, 0)).take(each),
                pa.array(w, mask=np.isnan(w)),
                pa.array(np.tile(model.explained, len(usable)), mask=np.isnan(np.tile(model.explained, len(usable)))),
                pa.array(np.full(many, error)),
            ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
