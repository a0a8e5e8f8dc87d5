"""Word shingles of raw UTF-8 texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_FIN = np.uint64(0xD6E8FEB86659FD93)


class WordIds(dict):
    """Word bytes to 64-bit hashes; forgets all when it holds ``limit`` words, so that memory stays bounded."""

    def __init__(self, limit: int = 1 << 19):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_ids(words: list[bytes], ids: WordIds) -> np.ndarray:
    return np.fromiter(map(ids.__getitem__, words), dtype=np.uint64, count=len(words))


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbours."""
    n = len(hashes) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = h * _MUL + hashes[i : i + n]
        h ^= h >> np.uint64(32)
    h *= _FIN
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, k: int, ids: WordIds) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z lower-cased, words split at ASCII white space.

    Fewer than ``k`` words make one shingle, no words an empty set.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = word_ids(words, ids)
    return np.unique(combine(hashes, min(k, len(words))))
