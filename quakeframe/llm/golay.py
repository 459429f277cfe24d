"""The binary Golay code of length 23: every 23-bit word lies within three bits of exactly one of its 4,096 codewords."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - (LENGTH - DATA)))
    return rest


@lru_cache(4)
def patterns(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of at most ``radius`` bits by syndrome: (patterns sorted by syndrome, offsets of length 2,049)."""
    errors = np.array([sum(1 << b for b in c) for w in range(radius + 1) for c in combinations(range(LENGTH), w)], np.int64)
    s = syndrome(errors)
    order = np.argsort(s, kind="stable")
    return errors[order], np.searchsorted(s[order], np.arange(1 << (LENGTH - DATA) | 1))


def nearby(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, codeword index) of every codeword within ``radius`` bits of each word."""
    errors, offsets = patterns(radius)
    s = syndrome(words)
    n = offsets[s + 1] - offsets[s]
    place = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[s], n)
    return place, (words[place] ^ errors[at]) >> (LENGTH - DATA)
