"""Word shingles as sorted arrays of distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CACHED_WORDS = 200_000


class WordHashes(dict):
    """Word to hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased; split at the six ASCII white-space characters, as bytes.split does."""
    return text.encode().lower().split()


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Distinct shingle hashes, sorted; fewer words than ``width``: all of them as one; no words: empty."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        acc = acc * _P + h[k : k + len(acc)]
    return np.unique(_finish(acc))
