"""The perfect binary Golay code [23, 12, 7]: decoding tables and fuzzy keys."""

from __future__ import annotations

from functools import cache

import numpy as np

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


@cache
def _error_of_syndrome() -> np.ndarray:
    """For each of the 2,048 syndromes the one error pattern of weight 3 or less."""
    bits = 1 << np.arange(23, dtype=np.int64)
    i, j, k = (x.ravel() for x in np.meshgrid(*[np.concatenate([[0], bits])] * 3))
    errors = np.unique(np.where((i == j) & (i > 0), 0, i ^ j) ^ np.where((k == i) | (k == j), 0, k))
    out = np.zeros(2048, np.int64)
    out[_remainder(errors)] = errors
    return out


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word; it is at distance 3 at most."""
    words = words.astype(np.int64)
    return (words ^ _error_of_syndrome()[_remainder(words)]) >> 11


def ball_keys(words: np.ndarray) -> np.ndarray:
    """(n, 24): indices of the codewords nearest to each word and to its 23 one-bit changes.

    A row has six distinct indices at most; the index of any word one bit away is among them."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int64)
    return decode((words.astype(np.int64)[:, None] ^ flips[None, :]).ravel()).reshape(-1, 24)
