"""Vectorised text handling for Arrow batches: words, hashes and shingles without a Python loop per word.

A *word* is a maximal run of bytes other than space and 0x09-0x0D. UTF-8 never uses those
bytes inside a longer character, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_rng = np.random.default_rng(0x5EED)
#: One random odd 64-bit value for each byte, and the base of the word polynomial.
BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, BASE, dtype=np.uint64), dtype=np.uint64)

#: Bytes of text that one vectorised step handles; a longer text gets a step of its own.
STEP_BYTES = 1_000_000


def powers(n: int) -> np.ndarray:
    """BASE**1 .. BASE**n modulo 2**64."""
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), BASE, dtype=np.uint64), dtype=np.uint64)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n+1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together stay near the limit; every row is in exactly one range."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (n+1 entries). No word crosses texts."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first = np.zeros(len(data), dtype=bool)
    inner = offsets[:-1]
    first[inner[inner < len(data)]] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (first | ~before))
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:] & ~first[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    shift = np.cumsum(size) - size
    within = np.arange(total) - np.repeat(shift, size)
    codes = BYTE_CODE[data[within + np.repeat(starts, size)]]
    codes *= powers(int(size.max()))[within]
    return mix(np.add.reduceat(codes, shift) + size.astype(np.uint64))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on, for positions that have k words; texts are not told apart."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= BASE
        out += words[j : j + n]
    return mix(out)


_UNBASE = np.uint64(pow(int(BASE), -1, 2**64))


class Runs:
    """Hashes of any run of words in constant time each, from prefix sums of the word polynomial."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(words * powers(n), out=self.prefix[1:])
        self.back = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, _UNBASE, dtype=np.uint64), out=self.back[1:])

    def hashes(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.prefix[hi] - self.prefix[lo]) * self.back[lo])


def leftmost_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each j the place of the first smallest of values[j : j + width]."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(values))
    done = 1
    while done < width:
        step = min(done, width - done)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        done += step
    return at


def text_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The words from ``starts`` to ``ends``, in order, joined by one space for each of n owners."""
    if len(starts) == 0:
        return pa.array([""] * n, pa.string())
    size = ends - starts + 1
    shift = np.cumsum(size) - size
    total = int(size.sum())
    take = np.arange(total) + np.repeat(starts - shift, size)
    last = shift + size - 1
    take[last] = 0
    out = data[take]
    out[last] = 0x20
    length = np.bincount(owner, weights=size, minlength=n).astype(np.int64)
    final = last[np.flatnonzero(np.diff(owner, append=-1))]
    out = np.delete(out, final)
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.maximum(length - 1, 0), out=offsets[1:])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def list_array(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column from the number of values of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
