"""Words and hashes of whole texts, as numpy arrays over Arrow batches.

A word is a run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``. Texts are read
in chunks of whole documents of about ``CHUNK_BYTES``, so memory is bounded by
the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(1, 11)[0]
_powers = np.ones(1, np.uint64)


def _byte_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _BYTE)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


class Words(NamedTuple):
    """Words of a chunk: ``bounds[i]:bounds[i + 1]`` are those of its document ``i``."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hash: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, last row + 1, bytes, offsets)`` of chunks of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def split(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Words of a chunk, A-Z lower-cased first when ``lower``."""
    n = len(buf)
    inside = _IN_WORD[buf]
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[1:-1]
        heads = heads[(heads > 0) & (heads < n)]
        first[heads] = inside[heads]
        last[heads - 1] = inside[heads - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    if not hashed or not len(start):
        return Words(start, end, bounds, np.zeros(len(start), np.uint64))
    chars = buf[inside]
    if lower:
        chars = _LOWER[chars]
    size = end - start
    at = np.cumsum(size) - size
    place = np.arange(len(chars)) - np.repeat(at, size)
    sums = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * _byte_powers(int(size.max()))[place], at)
    return Words(start, end, bounds, mix(sums + size.astype(np.uint64) * _ODD))


def grams(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words (also across documents; callers keep what lies inside one)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(constants(k, seed)):
        out += hashes[j : n + j] * c
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of ``[start, start + length)``, range after range."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(total)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new
