"""The extended binary Golay code (24, 12, 8) as a fuzzy hash of 24-bit words.

A word lies within distance 3 of exactly one codeword, or at distance 4 from exactly six.
``nearby`` gives the indices of these nearest codewords. Two words that differ in one bit
always share an index; with more bits apart they share one ever less often.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each 12-bit message; per syndrome the message parts of the coset's
    lightest error patterns (-1: none) and their number."""
    squares = {x * x % 11 for x in range(11)}
    b = np.zeros((12, 12), dtype=np.int64)
    for i in range(11):
        for j in range(11):
            b[i, j] = (i + j) % 11 not in squares
    b[:11, 11] = b[11, :11] = 1
    b[:11, :11] ^= 1
    rows = b @ (1 << np.arange(12))
    parity = np.zeros(4096, dtype=np.int64)
    for i in range(12):
        parity ^= np.where(np.arange(4096) >> i & 1, rows[i], 0)
    lead = np.full((4096, 6), -1, dtype=np.int64)
    count = np.zeros(4096, dtype=np.int64)
    best = np.full(4096, 99)
    for weight in range(5):
        for bits in combinations(range(24), weight):
            error = sum(1 << k for k in bits)
            s = parity[error & 4095] ^ (error >> 12)
            if weight <= best[s]:
                best[s] = weight
                lead[s, count[s]] = error & 4095
                count[s] += 1
    return parity, lead, count


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the nearest codewords of 24-bit words: an (n, 6) array, and the mask
    of its valid entries."""
    parity, lead, _ = _tables()
    message = words & 4095
    found = lead[parity[message] ^ (words >> 12)]
    return message[:, None] ^ found, found >= 0
