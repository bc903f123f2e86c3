"""Words of whole Arrow string columns, found and hashed without a Python loop.

A word is a longest run of bytes other than space and ``\\t \\n \\v \\f \\r``; its hash takes ``A-Z``
as ``a-z`` unless told otherwise. All of these are single bytes in UTF-8, so the bytes of a column can be cut without being
decoded. A null text has no words, like an empty one.

The hash of a word is a polynomial over its bytes modulo 2**64, each byte first replaced by a fixed
random number, and mixed at the end. It is a difference of two running sums, so its cost does not
depend on word lengths, and it is the same in every process and at every input size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; longer texts are hashed in one piece all the same.
BLOCK = 1 << 20


class Words(NamedTuple):
    """Words of some texts: text number, hash, and bytes ``data[start:end]`` of each word."""

    text: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    texts: int


@lru_cache(maxsize=2)
def _bytes_as_numbers(lower: bool) -> np.ndarray:
    table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return table[_LOWER] if lower else table


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, bounds, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_bounds(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after the other; ``space`` tells which bytes divide them."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(space[data], out=inside[1:-1])
    change = inside[1:] != inside[:-1]
    # A text's first byte starts a word even if the text before ends in one.
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts] & inside[cuts + 1]]
    starts = np.flatnonzero(change & inside[1:])
    ends = np.flatnonzero(change & inside[:-1])
    if len(joined):
        joined = np.unique(joined)
        starts = np.sort(np.concatenate([starts, joined]))
        ends = np.sort(np.concatenate([ends, joined]))
    return starts, ends


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    bits = max(10, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bytes_as_numbers(lower)[data] * _powers(_BASE, bits)[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, bits)[starts])


def words_of(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Words:
    """All words of a column; without ``lower`` the hash tells capital letters apart."""
    data, bounds = buffers(column)
    return hash_words(data, bounds, SPACE, lower)


def hash_words(data: np.ndarray, bounds: np.ndarray, space: np.ndarray, lower: bool) -> Words:
    """Words of texts that lie one after the other, divided by the bytes of ``space``."""
    starts, ends = word_bounds(data, bounds, space)
    text = np.searchsorted(bounds[1:], starts, side="right")
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # blocks of whole words keep the tables of powers small
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        piece = data[base:ends[last - 1]]
        hashes[first:last] = _hashes(piece, starts[first:last] - base, ends[first:last] - base, lower)
        first = last
    return Words(text, hashes, starts, ends, data, len(bounds) - 1)


def in_pieces(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each; a longer text is a slice by itself."""
    data, bounds = buffers(batch.column(column))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield batch.slice(first, last - first)
        first = last


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of each hash, the distinct hashes, and where each of these comes first."""
    codes, keys = pd.factorize(hashes)
    first = np.empty(len(keys), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, keys, first


def sums_by_text(values: np.ndarray, words: Words) -> np.ndarray:
    """Sum of a number per word, for each text."""
    return np.bincount(words.text, values, words.texts)
