"""The perfect binary Golay code (23, 12, 7) as a fuzzy hash of 23-bit words.

Every 23-bit word lies within 3 bits of exactly one codeword. The keys of a word are the numbers of all
codewords within 4 bits of it: one where the nearest is within 2 bits, else six. Two words that differ in
at most one bit share a key: the nearest codeword of either is within 4 bits of the other.
"""

from __future__ import annotations

import numpy as np

from chatloom.llm.base import per_process

#: Fixed values of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
BITS, DATA = 23, 12
CHECKS = BITS - DATA


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word, as a polynomial, by the generator."""
    left = np.asarray(words, np.int64).copy()
    for bit in range(BITS - 1, CHECKS - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return left


def patterns() -> np.ndarray:
    """By syndrome, the error patterns of at most 4 bits that lead to codewords; padded with -1 to six."""
    return per_process(("golay patterns",), _patterns)


def _patterns() -> np.ndarray:
    single = 1 << np.arange(BITS, dtype=np.int64)
    all_patterns, last = [np.zeros(1, np.int64)], np.zeros((1, 2), np.int64)
    for _ in range(4):
        grown = [(p | single[b], b + 1) for p, low in last for b in range(low, BITS)]
        last = np.array(grown, np.int64)
        all_patterns.append(last[:, 0])
    errors = np.concatenate(all_patterns)
    of = syndrome(errors)
    table = np.full((1 << CHECKS, 6), -1, np.int64)
    filled = np.zeros(1 << CHECKS, np.int64)
    weight = np.bitwise_count(errors)
    nearest = np.full(1 << CHECKS, 9)
    np.minimum.at(nearest, of, weight)
    for error, s, w in zip(errors.tolist(), of.tolist(), weight.tolist()):
        table[s, filled[s]] = error
        filled[s] += 1
    return table


def keys(words: np.ndarray) -> np.ndarray:
    """Codeword numbers near each word, six columns, -1 where there are fewer."""
    words = np.asarray(words, np.int64)
    errors = patterns()[syndrome(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)
