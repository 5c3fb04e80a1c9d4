"""Hashed word shingles of texts, computed in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = [np.uint64(x) for x in (30, 27, 31)]


def scrambled(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> _S[0])) * _M1
    x = (x ^ (x >> _S[1])) * _M2
    return x ^ (x >> _S[2])


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lowered; words are cut at ASCII white space only."""
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words make one shingle, no words none."""
    w = word_hashes(text)
    n = min(width, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = scrambled((h + STEP) ^ w[j : len(w) - n + 1 + j])
    return np.unique(h)
