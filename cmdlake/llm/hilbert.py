"""Places of points on a Hilbert curve, for whole arrays of points at once."""

from __future__ import annotations

import numpy as np


def keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Of whole-number points (n, d) with coordinates under 2**bits, the places on the curve: (n, ceil(d * bits / 8)) bytes, which sort as the curve runs.

    Coordinates are turned into the curve's transposed index in place, bit by bit from the top, by
    inversions and exchanges with the first axis, and a Gray code at the end.
    """
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    d = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    rows = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1  # (bits, d, n)
    return np.packbits(rows.reshape(bits * d, -1).T.astype(np.uint8), axis=1)
