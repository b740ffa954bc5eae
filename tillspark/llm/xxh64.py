"""XXH64 of many pieces of one byte buffer at once."""

from __future__ import annotations

import numpy as np

# Fixed values of the hash.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turned(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hash of data[start : start + size] for every piece; ``data`` must go on for 8 bytes behind the last piece."""
    data = np.ascontiguousarray(data)
    wide = np.ndarray(max(0, len(data) - 7), "<u8", data.data, strides=(1,))
    half = np.ndarray(max(0, len(data) - 3), "<u4", data.data, strides=(1,))
    seed = np.uint64(seed)
    at, left = start.astype(np.int64), size.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed + _P5, np.uint64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            lanes = [np.full(len(long), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            stripes = left[long] // 32
            for s in range(int(stripes.max())):
                on = np.flatnonzero(stripes > s)
                for k in range(4):
                    lanes[k][on] = _round(lanes[k][on], wide[at[long[on]] + 32 * s + 8 * k])
            x = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
            for lane in lanes:
                x = (x ^ _round(np.zeros_like(lane), lane)) * _P1 + _P4
            h[long] = x
            at[long] += 32 * stripes
            left[long] -= 32 * stripes
        h += size.astype(np.uint64)
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            h[on] = _turned(h[on] ^ _round(np.zeros(len(on), np.uint64), wide[at[on]]), 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        h[on] = _turned(h[on] ^ half[at[on]].astype(np.uint64) * _P1, 23) * _P2 + _P3
        at[on] += 4
        left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left >= 1)
            h[on] = _turned(h[on] ^ data[at[on]].astype(np.uint64) * _P5, 11) * _P1
            at[on] += 1
            left[on] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))
