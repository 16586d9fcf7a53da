"""Word hashes of whole Arrow text columns, computed with numpy over the column's own buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 2**62, 4, dtype=np.uint64) * np.uint64(8) + np.uint64(5)
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: The bytes between words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int = 0, inverse: bool = False) -> np.ndarray:
    """1, s, s^2, ... modulo 2^64 (or of the inverse of s), at least n of them."""
    key = (which, inverse)
    if key not in _powers or len(_powers[key]) < n:
        s = int(_STEP[which])
        s = pow(s, -1, 1 << 64) if inverse else s
        size = 1 << max(12, int(n - 1).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            out[done : 2 * done] = out[:done] * np.uint64(pow(s, done, 1 << 64))
            done *= 2
        _powers[key] = out
    return _powers[key][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_table(column: pa.Array, fold: np.ndarray = SAME, space: np.ndarray = SPACE, step: int = 1 << 16):
    """(start, end, hash, first) of all words of a column: byte ranges, 64-bit hashes of the folded bytes, and for each row
    the position of its first word (one more entry at the end). Work memory is bounded by step bytes, or one word."""
    data, at = text_buffer(column)
    n = len(data)
    starts, ends, hashes = [], [], []
    table = _BYTE[fold]
    cuts = np.zeros(n + 1, dtype=bool)
    cuts[at] = True  # a row's end also ends a word
    lo = 0
    while lo < n:
        hi = min(n, lo + step)
        while hi < n and not space[data[hi]] and not cuts[hi]:
            hi = min(n, hi + step)
            back = data[lo:hi]
            stops = np.flatnonzero(space[back] | cuts[lo:hi])
            if len(stops) and stops[-1]:
                hi = lo + int(stops[-1])
                break
        part = data[lo:hi]
        word = ~space[part]
        begin = word.copy()
        begin[1:] &= ~word[:-1] | cuts[lo + 1 : hi]
        last = word.copy()
        last[:-1] &= ~word[1:] | cuts[lo + 1 : hi]
        s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
        if len(s):
            length = e - s
            kept = part[word]
            first = np.concatenate(([0], np.cumsum(length)[:-1]))
            rel = np.arange(len(kept)) - np.repeat(first, length)
            h = np.add.reduceat(table[kept] * powers(int(length.max()))[rel], first)
            hashes.append(mix(h + length.astype(np.uint64) * _MIX[0]))
            starts.append(s + lo)
            ends.append(e + lo)
        lo = hi
    if not starts:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty.astype(np.uint64), np.zeros(len(at), dtype=np.int64)
    s, e, h = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    return s, e, h, np.searchsorted(s, at)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive values, by position; there are len(h) - k + 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += h[j : j + n] * _MIX[1 + j % 60]
    return mix(out + np.uint64(k))


def windows(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """As grams, for long windows: rolling sums, so that the cost does not depend on k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(len(h), which), dtype=np.uint64)))
    return mix((total[k:] - total[:-k]) * powers(n, which, inverse=True) + np.uint64(k))
