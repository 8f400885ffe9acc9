"""The perfect binary Golay code (23, 12, 7): every 23-bit word lies within three bits of exactly one codeword.

Two words within two bits of each other have a word within one bit of both; so the codewords of a word and of its
one-bit neighbours (one or six or so different ones) are keys of which two such words share at least one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS, CHECK_BITS = 23, 11
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the one-bit words, and by remainder the error pattern of at most three bits that has it."""
    single = []
    for k in range(BITS):
        value = 1 << k
        for bit in range(BITS - 1, CHECK_BITS - 1, -1):
            if value >> bit & 1:
                value ^= GENERATOR << (bit - CHECK_BITS)
        single.append(value)
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in (1, 2, 3):
        for at in combinations(range(BITS), weight):
            rest = 0
            for k in at:
                rest ^= single[k]
            errors[rest] = sum(1 << k for k in at)
    return np.array(single, np.int64), errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    single, errors = _tables()
    rest = np.zeros_like(words)
    for k in range(BITS):
        rest ^= (words >> k & 1) * single[k]
    return (words ^ errors[rest]) >> CHECK_BITS


def keys(words: np.ndarray, live_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct codeword indices of each word and of its neighbours in the low ``live_bits`` bits."""
    flips = np.concatenate(([0], 1 << np.arange(live_bits, dtype=np.int64)))
    found = np.sort(decode(words[:, None] ^ flips), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, _ = np.nonzero(new)
    return row, found[new]
