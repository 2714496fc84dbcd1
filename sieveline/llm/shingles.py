"""Word shingles of texts as 64-bit numbers, computed batch by batch inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[1]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """Hashes of the words in order; only A-Z are lower-cased, and only ASCII white space separates words.

    A text may come as its bytes, which need not be UTF-8.
    """
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text or b"")).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k words, in order; a shorter sequence is one window; none for no words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, np.uint64(width), np.uint64)
        for i in range(width):
            out = scramble(out * _MIX[0] + hashes[i : n - width + 1 + i])
    return out


def shingle_set(text: str | bytes | None, k: int) -> np.ndarray:
    return np.unique(windows(word_hashes(text), k))
