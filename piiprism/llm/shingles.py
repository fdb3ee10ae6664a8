"""Word shingles as 64-bit hashes, the same on every machine."""

from __future__ import annotations

import numpy as np
import xxhash

from . import common

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words() -> common.Remembered:
    """The hashes of words, for one task."""
    return common.Remembered(xxhash.xxh3_64_intdigest)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _M[3]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int, known: common.Remembered | None = None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; of a shorter text, one hash of all its words.

    A-Z is lower-cased; words are runs of anything but ASCII white space.
    """
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map((words() if known is None else known).__getitem__, split), np.uint64, len(split))
    n = len(h)
    k = min(width, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out * _M[0] + h[i : n - k + 1 + i] * _M[1] + _M[2])
    return np.unique(out)
