"""Words and word shingles of Arrow text columns as numpy arrays.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. Hashes have 64 bits and depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (in place where ``x`` is a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def upto(base: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return upto(BASE), upto(INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to ``n`` at least."""
    return _powers(max(SLICE + 1, 1 << int(n).bit_length()))


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of parts of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each row the number of words before it (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ``data[start:end]``."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each row, the sorted distinct hashes of its runs of ``size`` words; a shorter row has one run of all its words."""
    starts, ends, before = word_bounds(data, offsets)
    hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    whole = max(0, len(hashes) - size + 1)
    runs = np.zeros(whole, np.uint64)
    for k in range(size):
        runs += hashes[k : k + whole] * np.uint64((2 * k + 1) * BASE & (1 << 64) - 1)
    runs = mix(runs)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.sum(hashes[a:b] * (2 * np.arange(b - a, dtype=np.uint64) + np.uint64(1)), keepdims=True, dtype=np.uint64) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def commonest(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of ``counts`` (a column n) with the greatest n, at most ``limit`` of them: all from a step of n upwards.

    The step is found on a histogram of some hundred rows, so nothing is sorted and no more than ``limit`` rows leave Spark.
    """
    step = F.floor(F.log2("n") * 8)
    found = sorted((r["step"], r["rows"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect())
    least, rows = None, 0
    for at, more in reversed(found):
        rows += more
        if rows > limit:
            break
        least = at
    return counts.where(step >= least) if least is not None else counts.limit(0)
