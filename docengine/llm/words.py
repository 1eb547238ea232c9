"""Word hashing shared by the text operators."""

from __future__ import annotations

import numpy as np
import xxhash

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
CACHE_WORDS = 1 << 18


class WordIds(dict):
    """word -> 64-bit hash, remembered for up to CACHE_WORDS words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def seeds(name: str, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return np.array([xxhash.xxh64_intdigest(f"{name}:{i}") | 1 for i in range(n)], dtype=np.uint64)
