"""Vectorised words, substring hashes and windows over the UTF-8 bytes of a batch of texts.

A batch is one byte array and the offsets of its texts. Substring hashes come from prefix sums of a polynomial over
random byte values modulo 2**64, followed by a mixing step, so the hash of any substring costs two look-ups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial, its inverse modulo 2**64, and the mixing constants (fixed values).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

BYTE_VALUE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    c = column.fill_null("").cast(pa.large_binary())
    off = np.frombuffer(c.buffers()[1], np.int64, len(c) + 1, 8 * c.offset)
    data = np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]] if c.buffers()[2] else np.zeros(0, np.uint8)
    return data, off - off[0]


class Hashes:
    """Hashes of substrings of ``data``."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * powers(INVERSE, len(self.sums))[lo])

    def grams(self, q: int) -> np.ndarray:
        """Of every substring of q bytes."""
        n = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:n]) * powers(INVERSE, n)) if n > 0 else np.zeros(0, np.uint64)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-space bytes within a text, and the words before each text."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~SPACE[data]
    inner = off[(off > 0) & (off < len(data))]
    starts, ends = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    starts[inner] |= word[1:-1][inner]
    ends[inner - 1] |= word[1:-1][inner - 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, off)


def shingles(word_hash: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a text and the shingles before each text; a text of fewer words, but one at
    least, has its whole sequence as one shingle."""
    n = np.diff(first)
    some = np.zeros(len(word_hash), np.uint64)
    full = max(0, len(word_hash) - k + 1)
    if full:
        h = np.zeros(full, np.uint64)
        for i in range(k):
            h = h * np.uint64(BASE) + word_hash[i : i + full]
        some[:full] = mix(h)
    for i in np.flatnonzero((n > 0) & (n < k)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in word_hash[first[i] : first[i + 1]]:
                h = h * np.uint64(BASE) + w
            some[first[i]] = mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D + int(n[i]))]))[0]
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
    return some[place], at


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ascending, and how many come before each text."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[keep], np.searchsorted(d[keep], np.arange(len(at)))
