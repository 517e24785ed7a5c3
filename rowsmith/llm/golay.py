"""The perfect binary Golay code: 23 bits, 12 of data, up to 3 errors put right.

Every 23-bit word is within 3 bits of exactly one codeword. The codeword indices of a word and of its
23 one-bit neighbours are its *nearby indices*, at most 6 of them: two words that differ in at most two bits
have a common neighbour, hence a common nearby index.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

LENGTH = 23
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
CHECK_BITS = 11


def _remainders(words: np.ndarray) -> np.ndarray:
    left = words.copy()
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return left


def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Remainder of each byte at each place, and the error of each remainder."""
    byte = np.arange(256, dtype=np.int64)
    parts = [_remainders(byte << shift & ((1 << LENGTH) - 1)) for shift in (0, 8, 16)]
    errors = [sum(1 << b for b in chosen) for many in range(4) for chosen in combinations(range(LENGTH), many)]
    error_of = np.zeros(1 << CHECK_BITS, dtype=np.int64)
    error_of[_remainders(np.array(errors, dtype=np.int64))] = errors
    return parts, error_of


PARTS, ERROR_OF = _tables()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word."""
    syndrome = PARTS[0][words & 255] ^ PARTS[1][words >> 8 & 255] ^ PARTS[2][words >> 16]
    return (words ^ ERROR_OF[syndrome]) >> CHECK_BITS


def nearby_indices(words: np.ndarray, bits: int = LENGTH) -> np.ndarray:
    """One row per word: the sorted indices of it and its neighbours in the low ``bits`` bits, -1 for repeats."""
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
