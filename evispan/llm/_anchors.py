"""Content-defined anchors: of any stretch of bytes of a given length, at least one substring is picked by content alone."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_PLACE = np.uint64(24)  # low bits of a key that hold the place


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


_POW, _INV = _powers(1 << 20, _BASE), _powers(1 << 20, np.uint64(pow(int(_BASE), -1, 1 << 64)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every substring of ``width`` bytes, by content alone. ``data`` has less than 2**20 bytes."""
    sums = np.cumsum(np.append(np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POW[: len(data)]), dtype=np.uint64)
    return mix((sums[width:] - sums[:-width]) * _INV[: len(data) - width + 1])


def anchors(data: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of ``length`` bytes: (hash, place, first window, last window) of each.

    A window's anchor is its substring of ``width`` bytes of least hash, the leftmost of equals, so equal windows
    have equal anchors at equal places in them, wherever they lie; windows of one anchor follow each other.
    """
    n = len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    span = length - width + 1  # substrings of a window
    step = 1 << 19
    places, hashes = [], []
    for a in range(0, n, step):
        m = min(step, n - a)
        h = rolling(data[a : a + m + length - 1], width)
        low = np.uint64((1 << int(_PLACE)) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        done = 1
        while done < span:  # least key of spans of growing length
            shift = min(done, span - done)
            key = np.minimum(key[:-shift], key[shift:])
            done += shift
        at = (key[:m] & low).astype(np.int64)
        places.append(at + a)
        hashes.append(h[at])
    at, h = np.concatenate(places), np.concatenate(hashes)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return h[first], at[first], first, np.r_[first[1:], n] - 1
