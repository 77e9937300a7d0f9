"""SuperMinHash signatures with permutation ranks drawn from an affine group.

Every element gives each of the M slots a rank, the ranks of one element being
a permutation of 0..M-1, plus a fraction drawn for (element, rank); a slot keeps
the least sum over all elements.  With M prime the permutations
``rank -> a * rank + b (mod M)``, ``a`` not 0, send any two ranks to any two
slots equally often.  The estimator's mean and variance depend on pairs of slots
only, so they equal those under uniformly drawn permutations, and no state has
to be shuffled for an element.

Ranks are processed in ascending order.  Once every slot is taken by ranks below
r, rank r cannot lower any slot, and the rest is skipped: a text of n shingles
costs about max(n, M log M) steps rather than n * M.
"""

from __future__ import annotations

import numpy as np

from fieldloom.llm.shingles import mix

M, BANDS, ROWS = 257, 32, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signature(elements: np.ndarray) -> np.ndarray:
    """The M slot values of a set of 64-bit hashes; all infinite for the empty set."""
    slots = np.full(M, np.inf)
    n = len(elements)
    if not n:
        return slots
    a = ((elements >> np.uint64(32)) % np.uint64(M - 1)).astype(np.int64) + 1
    b = ((elements & np.uint64(0xFFFFFFFF)) % np.uint64(M)).astype(np.int64)
    rank, chunk = 0, max(1, min(M, -(-2000 // n)))
    while rank < M:
        ranks = np.arange(rank, min(M, rank + chunk))
        where = (a[None, :] * ranks[:, None] + b[None, :]) % M
        seeds = (ranks.astype(np.uint64) + np.uint64(1)) * _STEP
        fraction = (mix(elements[None, :] ^ seeds[:, None]) >> np.uint64(12)) * 2.0**-52
        np.minimum.at(slots, where.ravel(), (fraction + ranks[:, None]).ravel())
        rank, chunk = rank + len(ranks), max(1, chunk // 4)
        if slots.max() < rank:
            break
    return slots


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for each row of signatures (n x M)."""
    rows = np.ascontiguousarray(signatures[:, : BANDS * ROWS]).view(np.uint64).reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _STEP, rows.shape[:2]).copy()
    for i in range(ROWS):
        keys = mix(keys ^ rows[:, :, i]) + _STEP
    return keys


def agreement(x: np.ndarray, y: np.ndarray) -> float:
    """Share of equal slots: an unbiased estimate of the sets' Jaccard similarity."""
    return float(np.mean(x == y))
