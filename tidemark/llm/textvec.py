"""Word hashes and n-grams of whole batches of texts, as arrays.

A word is a maximal run of bytes above 0x20, so white space and control
characters of ASCII end it. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random value for each byte, from one generator.
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_BASE, _INVERSE))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each value over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and for each text the number of the first word at or after it (n + 1 of them)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = data > 32
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = ends[:-1][ends[:-1] < len(data)]
    opens[borders] = inside[borders]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * inverse[first])
    return first, last, hashes, np.searchsorted(first, ends)


def ngrams(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and for each text the number of its first (one more than texts)."""
    counts = np.maximum(np.diff(firsts) - n + 1, 0)
    begins = np.concatenate([[0], np.cumsum(counts)])
    where = np.arange(begins[-1]) + np.repeat(firsts[:-1] - begins[:-1], counts)
    out = np.zeros(len(where), np.uint64)
    for k in range(n):
        out = (out + hashes[where + k]) * _BASE
    return mix(out), begins
