"""A keyed pseudorandom permutation of 0 .. n-1, computable for any index alone."""

from __future__ import annotations

import numpy as np

ROUNDS = 6


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit finalising mixer of x and key."""
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permute(index: np.ndarray, n: np.ndarray | int, key: np.ndarray | int, back: bool = False) -> np.ndarray:
    """Images of ``index`` under the permutation of 0 .. n-1 that ``key`` picks, or under its inverse; n and key may differ by element.

    A balanced Feistel network permutes the next power of four at or above n; an image of n or more is sent
    through again (cycle walking) until it falls below n, which takes under four rounds on average.
    """
    x = np.asarray(index).astype(np.uint64)
    n = np.broadcast_to(np.asarray(n, dtype=np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key).astype(np.uint64), x.shape)
    half = np.zeros(x.shape, np.uint64)
    for b in range(1, 33):
        half += (n > np.uint64(1) << np.uint64(2 * b - 2)).astype(np.uint64)
    half = np.maximum(half, np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(x.size)
    with np.errstate(over="ignore"):
        while todo.size:
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            if back:
                left, right = right, left
            for r in range(ROUNDS)[:: -1 if back else 1]:
                left, right = right, left ^ (_mix(right, k + np.uint64(0x632BE59BD9B4E019 * (r + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11) & m)
            out[todo] = right << h | left if back else left << h | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)
