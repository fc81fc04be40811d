"""Elias-Fano coding of a non-decreasing sequence, with sampled select."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256


class EliasFano:
    """n values below or at ``most`` in about n * (2 + log2(most / n)) bits.

    The low bits of each value are packed; the high bits are a unary bitmap in which one-bit i stands at
    high(i) + i. ``samples`` holds the place of every 256-th one-bit, so select reads one short stretch.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        most = int(v[-1]) if n else 0
        width = max(0, (most // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        low = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, width, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.width, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, a, b, c = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        part = lambda lo, k, kind: np.frombuffer(data, kind, k, lo)
        return cls(n, width, part(at, a, np.uint8), part(at + a, b, np.uint8), part(at + a + b, c, "<u8"))

    def _low(self, i: int) -> int:
        lo, hi = i * self.width, (i + 1) * self.width
        bits = np.unpackbits(self.low[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + self.width]
        return int(sum(int(b) << k for k, b in enumerate(bits)))

    def select(self, i: int) -> int:
        """Value i, from the sampled one-bit before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, step = at // 8, 64
        skip = at % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + step], bitorder="little")
            bits[:skip] = 0
            ones = np.flatnonzero(bits)
            if len(ones) > left:
                return ((byte * 8 + int(ones[left]) - i) << self.width) | self._low(i)
            left, byte, skip = left - len(ones), byte + step, 0

    def select_range(self, lo: int, hi: int) -> np.ndarray:
        """Values lo..hi-1, from the stretch of one-bits between the samples around them."""
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        if lo == hi:
            return np.zeros(0, np.int64)
        begin = int(self.samples[lo // SAMPLE]) // 8
        last = -(-hi // SAMPLE)
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        ones = ones[ones >= self.samples[lo // SAMPLE]][lo % SAMPLE :][: hi - lo]
        high = (ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(self.width)
        if not self.width:
            return high.astype(np.int64)
        skip = lo * self.width % 8
        bits = np.unpackbits(self.low[lo * self.width // 8 : -(-hi * self.width // 8)], bitorder="little")[skip : skip + (hi - lo) * self.width]
        low = (bits.reshape(hi - lo, self.width).astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high | low).astype(np.int64)

    def values(self) -> np.ndarray:
        """All values."""
        return self.select_range(0, self.n)
