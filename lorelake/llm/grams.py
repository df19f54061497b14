"""Hashes of words and of runs of words, used by the shingle and repetition operators."""

from __future__ import annotations

import numpy as np
import xxhash

MAX_CACHED = 500_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    if len(cache) > MAX_CACHED:
        cache.clear()
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; fewer words than that give none."""
    count = max(0, len(hashes) - width + 1)
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count])
    return out
