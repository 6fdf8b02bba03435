"""Array kernels that the free-style operators run on Arrow buffers: word spans, polynomial hashes, grouped unique values."""

from __future__ import annotations

import numpy as np

U = np.uint64
_R = U(0x9E3779B97F4A7C15)
_RI = U(pow(int(_R), -1, 1 << 64))

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^0..R^n and its inverses, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, r in enumerate((_R, _RI)):
            p = np.full(size, r, U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the capital letters of Latin-1, in UTF-8 bytes."""
    data = _LOWER[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][up] += 0x20
    return data


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts and ends of all words, and the first word's index for each document (one more at the end). Words end with their document."""
    word = ~blank[data]
    starts, ends = word.copy(), word.copy()
    if len(data):
        inside = np.zeros(len(data) + 1, bool)
        inside[offsets] = True
        inside = inside[:-1]
        starts[1:] &= ~word[:-1] | inside[1:]
        ends[:-1] &= ~word[1:] | inside[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    p, _ = powers(len(values))
    s = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * p[: len(values)], out=s[1:])
    return s


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of the sequence whose prefix_sums these are; equal content, equal hash, wherever it stands."""
    _, q = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def window_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k items; one of length len(items) - k + 1."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for j in range(k):
        h = (h ^ items[j : j + n]) * U(0x9DDFEA08EB382D69) + U(j + 1)
        h ^= h >> U(29)
    return mix(h)


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and place within the row, for rows of these lengths laid end to end."""
    total = int(counts.sum())
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, at


def gather(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of pool[s:s+n]."""
    total = int(counts.sum())
    at = np.arange(total) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return pool[at]
