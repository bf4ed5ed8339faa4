"""Vectorised words: 64-bit hashes of the words of many texts at once, straight from Arrow's string buffers.

A word is a run of bytes other than space and tab to carriage return; A to Z are lower-cased.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 2**64)
_POW: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, np.uint64(base % 2**64))
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POW[base] = have
    return have[:n]


def spans_hash(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of values[lo:hi] for each span; equal runs of values have equal hashes."""
    n = len(values)
    if not len(lo):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_MULT, n), out=sums[1:])
    return mix((sums[hi] - sums[lo]) * powers(_INV, n + 1)[lo] + (hi - lo).astype(np.uint64))


class Words(NamedTuple):
    """hash: of each word in order; first: where each text's words begin (and the end); lo, hi: byte places; data: the bytes."""

    hash: np.ndarray
    first: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    data: np.ndarray
    starts: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (nulls are empty), and where each text begins (and the end)."""
    column = pa.compute.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(column: pa.Array) -> Words:
    data, starts = buffers(column)
    n = len(data)
    is_word = ~_SPACE[data]
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    inner = starts[1:-1]
    inner = inner[inner < n]
    begin[inner] |= is_word[inner]  # a text's first byte starts a word whatever precedes it
    lo = np.flatnonzero(begin)
    stop = np.ones(n + 1, bool)
    stop[:n] = ~is_word
    stop[1:n] |= begin[1:]
    ends = np.flatnonzero(stop[1:] & np.r_[is_word]) + 1 if n else np.zeros(0, np.int64)
    return Words(spans_hash(_VALUE[data], lo, ends), np.searchsorted(lo, starts), lo, ends, data, starts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i+1]] for each i; empty runs give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind != "b" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
