"""Filters of a fixed size for use inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Filter:
    """Two bits per key in a table of ``2**bits`` bits: may say yes wrongly, never no.

    Its size does not depend on the number of keys; more keys only let more through.
    """

    def __init__(self, table: np.ndarray, bits: int) -> None:
        self.table, self.bits = table, bits

    def __contains__(self, keys: np.ndarray) -> np.ndarray:
        raise TypeError("use has()")

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For 64-bit keys whose bits are well mixed."""
        keys = keys.view(np.uint64)
        mask = np.uint64((1 << self.bits) - 1)
        out = self._bit(keys & mask)
        if out.any():
            some = np.flatnonzero(out)
            out[some] = self._bit((keys[some] >> np.uint64(63 - self.bits)) & mask)
        return out

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def filter_of(keys: DataFrame, column: str, bits: int = 24) -> Filter:
    """A filter over a bigint column; the driver gets at most ``2**bits / 64`` numbers."""
    key = F.col(column)
    mask = (1 << bits) - 1
    places = F.array(key.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 63 - bits).bitwiseAND(F.lit(mask)))
    words = keys.where(key.isNotNull()).select(F.explode(places).alias("b")).groupBy(
        F.shiftright("b", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Filter(table, bits)
