"""Word shingles, MinHash signatures and the posterior bounds of their agreement.

Numpy helpers that run inside tasks, one text or one pair of blocks at a time.
"""

from __future__ import annotations

from hashlib import blake2b
from math import ceil, comb, log

import numpy as np
import xxhash

WORDS = 5
BANDS = 25
BAND_ROWS = 5
HASHES = BANDS * BAND_ROWS

# A pair of the least similarity shares no band with at most this probability.
BAND_MISS = 5e-7

# Signature positions compared before each look at the posterior.
LOOK = 25



def bands(threshold: float) -> int:
    """Bands that miss a pair of this similarity with BAND_MISS, in whole looks: 25 at 0.85,
    40 at 0.8."""
    share = threshold ** BAND_ROWS
    least = ceil(log(BAND_MISS) / log(1 - share)) if share < 1 else 1
    step = LOOK // BAND_ROWS
    return -(-least // step) * step


_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEED = 20240229


class WordHashes(dict):
    """Word -> 64-bit hash, kept for frequent words; cleared when it grows large."""

    def __init__(self, limit: int = 150_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(data: bytes, hashes: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text.

    A-Z are lower-cased, words end at ASCII white space. A text of fewer words is one
    shingle, one without words has none.
    """
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    rolled = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        rolled = rolled * _ODD + h[i:len(h) - width + 1 + i]
    return np.unique(_mix(rolled))


def multipliers(hashes: int = HASHES) -> np.ndarray:
    draw = np.random.default_rng(_SEED).integers(0, 1 << 63, hashes, np.uint64)
    return draw * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray, step: int = 2048) -> np.ndarray:
    """Smallest value of every hash over the set, its upper 32 bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), step):
        np.minimum(least, (shingles[None, start:start + step] * factors[:, None]).min(axis=1),
                   out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def set_digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def least_matches(threshold: float, miss: float, hashes: int = HASHES,
                  look: int = LOOK) -> list[tuple[int, int]]:
    """After n compared positions: the fewest matches a pair may have and go on.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m matches of n, and
    P(similarity >= t) equals P(Binomial(n + 1, t) <= m). Fewer matches make it < `miss`.
    """
    bounds = []
    for n in range(look, hashes + 1, look):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        bounds.append((n, m))
    return bounds


def survivors(left: np.ndarray, right: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Matches of each pair of signatures that passes every look, -1 for pruned ones."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    start = 0
    for n, least in bounds:
        matches[alive] += (left[alive, start:n] == right[alive, start:n]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        start = n
    out = np.full(len(left), -1, np.int32)
    out[alive] = matches[alive]
    return out
