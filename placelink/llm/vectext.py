"""Whole-batch text kernels in numpy: UTF-8 buffers, word spans, word and window hashes.

Hashes are 64 bit: random byte codes in a polynomial modulo 2**64 with an odd base, then a
finaliser. Two different strings share a hash with a chance of about 2**-60.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


@functools.lru_cache(2)
def _powers(bits: int, inverse: bool) -> np.ndarray:
    base = pow(BASE, -1, 2**64) if inverse else BASE
    out = np.ones(1, np.uint64)
    while len(out) < 1 << bits:
        out = np.concatenate([out, out * U(pow(base, len(out), 2**64))])
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers(max(16, int(n - 1).bit_length()), inverse)


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums; ``span_hash`` takes differences."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(CODE[b] * powers(len(b))[: len(b)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True)[start])


def word_spans(b: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
    """Starts and ends of the runs without white space, and the row of each."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~space[b]
    first = np.zeros(len(b) + 1, bool)
    first[off] = True
    before = np.empty(len(b), bool)
    before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(b), bool)
    after[-1], after[:-1] = False, word[1:]
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) and the n + 1 offsets of rows among them."""
    b, off = utf8(col)
    b = LOWER[b]
    start, end, row = word_spans(b, off)
    h = span_hash(prefix_hash(b), start, end)
    return h, np.searchsorted(row, np.arange(len(off)))


def shingles(col: pa.Array, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a shorter text is one
    shingle, a text without words none."""
    h, at = words(col)
    seeds = np.array([pow(BASE, 2 * i + 3, 2**64) for i in range(k)], dtype=np.uint64)
    grams = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        grams += h[i : i + len(grams)] * seeds[i]
    grams = mix(grams)
    out = []
    for a, z in zip(at[:-1], at[1:]):
        if z - a >= k:
            out.append(np.unique(grams[a : z - k + 1]))
        elif z > a:
            out.append(mix((h[a:z] * seeds[: z - a]).sum(keepdims=True, dtype=np.uint64) + U(int(z - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, ... for each run, one run after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return step + np.arange(total)
