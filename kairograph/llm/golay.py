"""The perfect binary Golay code of length 23, as array operations."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: The length, the index bits, and a generator polynomial of the code.
LENGTH = 23
INDEX_BITS = 12
GENERATOR = 0b110001110101


@cache
def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes by byte of a word, and the error of at most three bits of each syndrome."""
    of_bit = []
    for bit in range(LENGTH):
        rest = 1 << bit
        for top in range(LENGTH - 1, 10, -1):
            if rest >> top & 1:
                rest ^= GENERATOR << (top - 11)
        of_bit.append(rest)
    by_byte = []
    for low in (0, 8, 16):
        part = np.zeros(256, np.int64)
        for k in range(min(8, LENGTH - low)):
            part[(np.arange(256) >> k & 1) == 1] ^= of_bit[low + k]
        by_byte.append(part)
    errors = np.zeros(2048, np.int64)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= of_bit[b]
            errors[syndrome] = sum(1 << b for b in bits)
    return by_byte, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within distance three of each 23-bit word; there is just one."""
    by_byte, errors = _tables()
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16 & 127]
    return (words ^ errors[syndrome]) >> 11


def nearby(words: np.ndarray) -> np.ndarray:
    """Indices of the words' 24 variants with at most one bit changed, one row each.

    A row holds one index or six different ones. Words that differ in one bit
    have each other's own index in their rows.
    """
    flips = np.array([0, *(1 << b for b in range(LENGTH))], np.int64)
    return decode(words[:, None] ^ flips[None, :])
