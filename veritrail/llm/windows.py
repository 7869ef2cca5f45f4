"""Rolling hashes of byte windows, vectorised with numpy.

A prefix sum of ``code[byte] * base**i`` (mod 2**64) gives the hash of any
window in constant time. Two bases give 128 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) + U(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Roller:
    """Window hashes of buffers of up to ``size`` bytes."""

    def __init__(self, size: int, seed: int) -> None:
        base = int(_splitmix(1, seed)[0]) | 5
        inverse = pow(base, -1, 1 << 64)
        self.code = _splitmix(256, seed + 1) | U(1)
        self.up, self.down = (self._powers(b, size) for b in (base, inverse))

    @staticmethod
    def _powers(b: int, n: int) -> np.ndarray:
        out = np.full(n, b, U)
        out[0] = 1
        return np.multiply.accumulate(out)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        """Sums for windows of bytes, or of hashes (uint64) as they are."""
        out = np.zeros(len(raw) + 1, U)
        np.cumsum((self.code[raw] if raw.dtype == np.uint8 else raw) * self.up[: len(raw)], out=out[1:])
        return out

    def window(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])

    def every(self, prefix: np.ndarray, length: int) -> np.ndarray:
        m = len(prefix) - length
        return mix((prefix[length:] - prefix[:m]) * self.down[:m])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, in log(width) passes."""
    s = 1
    while 2 * s <= width:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    o = width - s
    return np.minimum(x[:-o], x[o:]) if o else x
