"""Hashes of all substrings of a byte buffer, and its words, in numpy."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """64-bit hashes of any substrings of a buffer, from sums of powers of an odd base."""

    POWERS = powers(BASE, 1 << 16), powers(pow(BASE, -1, 1 << 64), 1 << 16)
    CODES = np.random.default_rng(97).integers(1, 1 << 63, 256).astype(np.uint64)

    def __init__(self, data: np.ndarray):
        if len(data) >= len(self.POWERS[0]):
            n = 1 << len(data).bit_length()
            Hashes.POWERS = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.CODES[data] * self.POWERS[0][: len(data)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.POWERS[1][start]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't ASCII white space."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    return edge[::2], edge[1::2]
