"""SetSketch: registers that hold exponentially spaced, truncated minima of exponential hash values of a set.

Each element gives each of the M registers one value: the j-th smallest of the M lies in the j-th of M intervals of equal
probability under the exponential distribution, and a pseudo-random permutation of the element says which register it meets.
A register keeps the least value x of all elements as floor(1 - log_BASE(x)), cut off to one byte. So

* the sketch of a union is the elementwise maximum of the sketches (merge());
* two registers are equal with a probability that grows with the Jaccard similarity and is never below it, so that runs of
  registers can be used as bands of a locality-sensitive index;
* how many registers are equal, larger and smaller gives, with the set sizes, the likelihood of each similarity.

M is a prime: register = (start + j * step) mod M with start and step from the element's hash meets any two registers
equally often. Sets are arrays of distinct 64-bit hashes. The registers of an empty set are all 0.
"""

from __future__ import annotations

import numpy as np

from pricewatch.llm.shared import mix

#: Registers of a sketch, ratio of neighbouring register values, rate of the exponential values, largest register value.
M, BASE, RATE, TOP = 281, 1.15, 20.0, 255
#: Elements that are sketched at once; longer sets are sketched in parts and merged.
PART = 1 << 16
_UNIT = 2.0 ** -53


def _least(hashes: np.ndarray) -> np.ndarray:
    """Of each register the least value in units of the M intervals, so that value j + u is in interval j."""
    start = (mix(hashes, 1) % np.uint64(M)).astype(np.int64)
    step = (mix(hashes, 2) % np.uint64(M - 1)).astype(np.int64) + 1
    least = np.full(M, np.inf)
    done, rounds = 0, int(M * (np.log(M) + 3) / len(hashes)) + 1
    while done < M:
        j = np.arange(done, min(M, done + rounds))
        with np.errstate(over="ignore"):
            drawn = mix(hashes[:, None] + j.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), 3)
        value = j[None, :] + (drawn >> np.uint64(11)).astype(np.float64) * _UNIT
        np.minimum.at(least, ((start[:, None] + j[None, :] * step[:, None]) % M).ravel(), value.ravel())
        done = int(j[-1]) + 1
        if least.max() < done:  # later intervals hold larger values only
            break
    return least


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of distinct 64-bit hashes: M bytes."""
    if len(hashes) == 0:
        return np.zeros(M, dtype=np.uint8)
    least = _least(hashes[:PART])
    for at in range(PART, len(hashes), PART):
        np.minimum(least, _least(hashes[at:at + PART]), out=least)
    x = -np.log1p(-np.minimum(least / M, 1 - _UNIT)) / RATE
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(x) / np.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union, given those of two sets, or of rows of sets."""
    return np.maximum(a, b)


def bands(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` registers of each sketch; the number of the band is part of the key."""
    n = M // rows
    parts = sketches[:, :n * rows].reshape(len(sketches), n, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64)[None, :] + np.uint64(1), parts.shape[:2])
    for i in range(rows):
        key = mix(key + parts[:, :, i], 11 + i)
    return key.view(np.int64)


def band_rows(similarity: float, miss: float = 1e-6) -> int:
    """The longest bands with which two sets of this similarity fail to meet in any band with a probability of at most `miss`."""
    return max(r for r in range(1, M + 1) if r == 1 or (1 - similarity ** r) ** (M // r) <= miss)


def _step(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(similarity: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Log-likelihood of a similarity if `over` registers of a are larger than those of b and `under` are smaller; the rest are equal."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = np.maximum(_step(np.maximum(u - v * similarity, 0)), 1e-12)
    q = np.maximum(_step(np.maximum(v - u * similarity, 0)), 1e-12)
    return over * np.log(p) + under * np.log(q) + (M - over - under) * np.log(np.maximum(1 - p - q, 1e-12))


def estimate(n_a: np.ndarray, n_b: np.ndarray, over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs of non-empty sets of known size: the likelihood has one peak, found by ternary search."""
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    low, high = np.zeros(len(n_a)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    for _ in range(40):
        third = (high - low) / 3
        left = log_likelihood(low + third, n_a, n_b, over, under) < log_likelihood(high - third, n_a, n_b, over, under)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def may_reach(similarity: float, n_a: np.ndarray, n_b: np.ndarray, over: np.ndarray, under: np.ndarray, doubt: float = 14.0) -> np.ndarray:
    """False for the pairs whose registers speak against this similarity: the estimate is below it and more than exp(doubt) times as
    likely. A pair that reaches it fails with a probability of about 1e-7."""
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    found = estimate(n_a, n_b, over, under)
    at = np.minimum(similarity, np.minimum(n_a, n_b) / np.maximum(n_a, n_b))
    gap = log_likelihood(found, n_a, n_b, over, under) - log_likelihood(at, n_a, n_b, over, under)
    return (found >= similarity) | (gap <= doubt)
