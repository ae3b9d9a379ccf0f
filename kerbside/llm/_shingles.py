"""Words and shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words: A-Z in lower case, cut at blanks and the control characters 9 to 13."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()  # of bytes, both methods look at ASCII alone
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of exactly ``k`` words, in text order."""
    n = len(words) - k + 1
    if n <= 0 or k <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * _P
        h ^= h >> np.uint64(29)
    return mixed(h)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Runs of ``k`` words; of fewer words the whole sequence; of none nothing."""
    return runs(words, min(k, len(words)))


def permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets, as columns, of ``count`` permutations of 64-bit numbers."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, np.uint64)
    return a[:, None], b[:, None]
