"""Strictly sequential rules over ordered rows, for what no window can express."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Fold = Callable[[tuple, Iterator[tuple]], Iterable[tuple]]

_OUT_ROWS = 20_000
_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
    "boolean": pa.bool_(),
}


def sequential(
    df: DataFrame, key: Sequence[str], order: Sequence[str], fold: Fold, schema: str,
    spread: Sequence[str] = (), placed: bool = False,
) -> DataFrame:
    """Runs ``fold(key, rows)`` over the rows of each key in order.

    Rows are hashed by the key, sorted inside Spark, and streamed through the fold in Arrow
    batches: a task holds one batch and the fold's own state, never a whole key. ``spread`` names
    columns that cut a key into independent stretches (see ``scan.segments``), each its own unit.
    ``placed`` says that a window over the same unit has brought its rows together already.
    Input that can be summed to one row per clock tick should be, before it comes here.
    """
    unit = [*key, *spread]
    rest = [c for c in df.columns if c not in unit]
    target = pa.schema([
        (f.name, _ARROW[f.dataType.simpleString()]) for f in T.StructType.fromDDL(schema).fields
    ])
    width, n_key = len(unit), len(key)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns])

        out: list[tuple] = []
        for unit_key, group in itertools.groupby(rows(), key=lambda r: r[:width]):
            key_values = unit_key[:n_key]
            for cells in fold(key_values, (r[width:] for r in group)):
                out.append(key_values + tuple(cells))
                if len(out) >= _OUT_ROWS:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    ordered = df.select(*unit, *rest)
    if not placed:
        ordered = ordered.repartition(*unit)
    return ordered.sortWithinPartitions(*unit, *order).mapInArrow(run, schema)
