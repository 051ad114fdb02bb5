"""Vectorised hashing of words and word n-grams over the bytes of many texts at once.

Words are the runs of bytes outside 0x20 and 0x09-0x0D, after A-Z are lower-cased; a 64-bit hash stands for each.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240601)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, base: np.uint64 = STEP) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its row, its first byte) for texts that lie one after another in buf."""
    if not len(buf):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = fold[buf]
    inside = ~separators[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = off[:-1][off[:-1] < len(buf)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf))), axis=0) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf))))])
    value = BYTE_CODES[low] * powers(int(at.max()) + 1)[at]
    value[~inside] = 0
    words = mix(np.add.reduceat(value, starts))
    return words, np.searchsorted(off, starts, "right") - 1, starts


def ngrams(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of the first word) of every run of size words inside a row.

    With short, a row of fewer words (one at least) gives its whole sequence as one.
    """
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    full = max(0, len(words) - size + 1)
    key = np.zeros(full, U)
    for k in range(size):
        key = key * STEP + words[k : k + full]
    same = rows[:full] == rows[size - 1 :][:full]
    at = np.flatnonzero(same)
    key, row = mix(key[at] + U(size)), rows[:full][at]
    if short:
        for r in np.flatnonzero((count > 0) & (count < size)):
            whole = U(0)
            with np.errstate(over="ignore"):
                for w in words[first[r] : first[r] + count[r]]:
                    whole = whole * STEP + w
            key, row, at = np.append(key, mix(np.array([whole + U(1000 + count[r])]))), np.append(row, r), np.append(at, first[r])
    return key, row, at
