"""Hashes of many pieces of UTF-8 at once, for Arrow batches in Python workers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A number for each byte, and odd numbers for places and sizes.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1342543DE82EF95))
STEP = mix(np.arange(1, 65, dtype=np.uint64)) | U64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """A hash of each span of ``values`` (64-bit numbers), of what it holds and its size.

    ``least``: the powers that are kept between calls reach at least so far.
    """
    up, down = _powers(1 << (max(len(values), least) - 1).bit_length())
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP[63])
