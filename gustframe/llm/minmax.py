"""Min-max hashing: signatures, band keys and exact Jaccard of word-shingle sets."""

from __future__ import annotations

import numpy as np

from gustframe.llm.wordhash import mix

SHINGLE = 5
#: Band = 8 one-byte values (min and max of 4 permutations); 44 bands miss a pair of similarity 0.85
#: with probability (1 - 0.85**8)**44 < 1e-6.
BANDS, ROWS = 44, 8
PERMUTATIONS = BANDS * ROWS // 2
VALUES = BANDS * ROWS
PARITY_BITS = 2048
#: A pair of similarity 0.85 has an estimate below this with a chance of about 1e-11 (over six deviations).
LEAST_ESTIMATE = 0.72

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    a = rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a[:, None], rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]


_A, _B = _permutations()


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text's word hashes.

    Fewer than five words are one shingle, no words are none.
    """
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = out * _STEP + words[k:k + n]
    return np.unique(mix(out))


def signature(s: np.ndarray) -> np.ndarray:
    """One byte each of the minimum and the maximum under every permutation: BANDS keys of 8 bytes."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 512):      # in blocks that stay in the cache, whatever the length
        h = _A * x[i:i + 512] + _B
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    both = np.stack([low, high], axis=1).ravel()
    both = (both * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return both.astype(np.uint8).view("<i8")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimates from rows of band keys: equal bytes, less those that agree by chance."""
    equal = (a.view(np.uint8) == b.view(np.uint8)).reshape(*a.shape[:-1], VALUES).mean(axis=-1)
    return (equal - 1 / 256) / (1 - 1 / 256)


def parity(s: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes in each of PARITY_BITS bins, packed to longs.

    Two sets' parities differ in at most as many bits as their symmetric difference has members, so
    the count of differing bits is a lower bound that never rejects a linked pair.
    """
    odd = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def possible(n_a, parity_a, n_b, parity_b, percent: int = 85) -> np.ndarray:
    """False only where the parities prove 100 * intersection < percent * union."""
    differ = np.bitwise_count(parity_a.view(np.uint64) ^ parity_b.view(np.uint64)).sum(axis=-1, dtype=np.int64)
    total = np.asarray(n_a, np.int64) + np.asarray(n_b, np.int64)
    return differ * (100 + percent) <= total * (100 - percent)


def linked(a: np.ndarray, b: np.ndarray, percent: int = 85) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes; empty sets link with nothing."""
    if not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
