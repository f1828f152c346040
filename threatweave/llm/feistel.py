"""Keyed permutations of 0..n-1 for any n: balanced Feistel network with cycle-walking."""

from __future__ import annotations

import numpy as np

ROUNDS = 6
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _walk(x, n, key, back: bool) -> np.ndarray:
    x = np.array(x, np.uint64, copy=True)
    n = np.broadcast_to(np.asarray(n, np.uint64), x.shape)
    key = np.broadcast_to(np.asarray(key, np.uint64), x.shape)
    # The network works on 2 * half bits, less than four times n: few steps stay outside.
    bits = np.frexp((np.maximum(n, np.uint64(2)) - np.uint64(1)).astype(np.float64))[1]
    half = ((bits + 1) // 2).astype(np.uint64)
    todo = np.arange(x.size)
    while todo.size:
        h, k = half[todo], key[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        left, right = x[todo] >> h, x[todo] & mask
        with np.errstate(over="ignore"):
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                round_key = mix(k + _GOLDEN * np.uint64(r + 1))
                if back:
                    left, right = right ^ (mix(round_key ^ left) & mask), left
                else:
                    left, right = right, left ^ (mix(round_key ^ right) & mask)
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo]]
    return x


def permute(x, n, key) -> np.ndarray:
    """Where the keyed permutation of 0..n-1 sends ``x``. ``n`` (below 2**53) and ``key`` may differ by element."""
    return _walk(x, n, key, back=False)


def invert(y, n, key) -> np.ndarray:
    """What :func:`permute` sends to ``y``."""
    return _walk(y, n, key, back=True)
