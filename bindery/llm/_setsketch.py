"""SetSketch registers: exponentially spaced, truncated minima of hash points.

Every shingle owns a Poisson process of points, each on one of M registers; a
register keeps the smallest point of all shingles of a set, on a scale of
powers of BASE (so the register-wise maximum of two sketches is the sketch of
the union).  Two sets agree in a register with a probability close to their
Jaccard similarity, which bands use; counts of larger, smaller and equal
registers, with the known set sizes, give the similarity's likelihood.
"""

from __future__ import annotations

import numpy as np

from ._text import U64, mix

M = 120
ROWS = 4  # registers a band: at a similarity of 0.8, all 30 bands differ with odds of 1.4e-7
BASE = 1.001
_RATE = 20.0  # keeps the scale positive for sets of one
_STEP = 8


def sketch(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers (sets x M, uint16) of consecutive sets of distinct shingles; an empty set has zeros."""
    n = len(counts)
    least = np.full(n * M, np.inf)
    owner = np.repeat(np.arange(n), counts)
    limit = (np.log(M) + 3.0) / np.maximum(counts, 1)
    open_sets = np.flatnonzero(counts)
    chosen = slice(None)
    while len(open_sets):
        _points(shingles[chosen], owner[chosen], limit, least)
        unfilled = np.isinf(least.reshape(n, M)).any(1) & (counts > 0)
        open_sets = np.flatnonzero(unfilled)
        limit[open_sets] *= 2
        chosen = np.flatnonzero(unfilled[owner])
    least = least.reshape(n, M)
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least / _RATE) / np.log(BASE))
    return np.where(np.isinf(least), 0, np.clip(level, 0, 65535)).astype(np.uint16)


def _points(shingle: np.ndarray, owner: np.ndarray, limit: np.ndarray, least: np.ndarray) -> None:
    """All points up to the owner's limit, into the registers."""
    reached, j = np.zeros(len(shingle)), 0
    while len(shingle):
        step = 1 if j == 0 else _STEP  # most shingles of a long text have no point that counts
        for _ in range(step):
            bits = mix(shingle, 2 * j + 500)
            reached = reached - np.log(((bits >> U64(11)).astype(np.float64) + 1) * 2.0**-53) / M
            j += 1
            inside = reached <= limit[owner]
            if not inside.all():
                shingle, owner, reached, bits = shingle[inside], owner[inside], reached[inside], bits[inside]
                if not len(shingle):
                    return
            register = ((mix(bits, 3) >> U64(32)) * U64(M) >> U64(32)).astype(np.int64)
            np.minimum.at(least, owner * M + register, reached)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(sets x bands) 64-bit keys of ROWS neighbouring registers each."""
    parts = registers.reshape(len(registers), -1, ROWS).astype(np.uint64)
    key = np.arange(parts.shape[1], dtype=np.uint64) + U64(1)
    key = np.broadcast_to(key, parts.shape[:2])
    for k in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, k], 77 + k)
    return key


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (pairs x M) of sets of known size."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ln = np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p_more = -np.log1p(-np.maximum(u - v * j, 0) * (BASE - 1) / BASE) / ln
        p_less = -np.log1p(-np.maximum(v - u * j, 0) * (BASE - 1) / BASE) / ln
        same = np.maximum(1 - p_more - p_less, 1e-12)
        return more * np.log(np.maximum(p_more, 1e-12)) + less * np.log(np.maximum(p_less, 1e-12)) + equal * np.log(same)

    golden = (5**0.5 - 1) / 2
    for _ in range(24):  # concave in the similarity: golden sections
        left, right = high - golden * (high - low), low + golden * (high - low)
        better = likelihood(left) > likelihood(right)
        low, high = np.where(better, low, left), np.where(better, right, high)
    return (low + high) / 2
