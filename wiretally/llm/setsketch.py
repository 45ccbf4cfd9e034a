"""SetSketch: mergeable registers that estimate set sizes and Jaccard similarity.

A register holds the smallest of one exponential variate per element on a logarithmic
scale of base B, cut off at both ends. Registers of a union are the larger ones of both
sets, and the share of equal registers grows with the Jaccard similarity, so bands of
registers serve as keys for similarity search.

The variates of an element come from one multiply-and-add hash per register. The minimum
is taken over hashes; only the m minima are put on the scale.
"""

from __future__ import annotations

import numpy as np

BANDS, ROWS = 24, 3
M = BANDS * ROWS           # registers
B = 1.001
A = 20.0                   # rate of the variates
Q = 2**16 - 2

_rng = np.random.default_rng(2021)
_mul = _rng.integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_add = _rng.integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_band_mul = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[sets, M] of sets that lie one after the other in `elements` (64-bit hashes); none is empty."""
    least = np.empty((len(starts), M), np.uint64)
    held = np.empty_like(elements)
    for i in range(M):
        np.multiply(elements, _mul[i], out=held)
        np.add(held, _add[i], out=held)
        least[:, i] = np.minimum.reduceat(held, starts)
    u = (least >> np.uint64(11)).astype(np.float64) * 2.0**-53
    x = np.maximum(-np.log1p(-u) / A, 1e-300)
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def cardinality(k: np.ndarray) -> np.ndarray:
    """Estimated set size of each row of registers."""
    return M * (1 - 1 / B) / (A * np.log(B) * np.power(B, -k.astype(np.float64)).sum(-1))


def band_keys(k: np.ndarray) -> np.ndarray:
    """[sets, BANDS]: a 64-bit key of each band's registers."""
    v = (k.reshape(len(k), BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _band_mul
    h = np.zeros((len(k), BANDS), np.uint64)
    for i in range(ROWS):
        h ^= v[:, :, i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _counts(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> tuple[np.ndarray, ...]:
    """How many registers of each pair of rows are larger, smaller and equal, and each set's share of both sizes."""
    more, less = (ku > kv).sum(-1), (ku < kv).sum(-1)
    return more, less, ku.shape[-1] - more - less, nu / (nu + nv), nv / (nu + nv)


def _likelihood(j: np.ndarray, more, less, equal, u, v) -> np.ndarray:
    """Logarithm of the joint likelihood of the registers if the Jaccard similarity is j."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    above, below = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    return more * log(above) + less * log(below) + equal * log(1 - above - below)


def jaccard(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray, steps: int = 200) -> np.ndarray:
    """Jaccard similarity of each pair of rows by maximum likelihood, given both set sizes."""
    more, less, equal, u, v = _counts(ku, kv, nu, nv)
    j = np.minimum(u / v, v / u)[:, None] * np.linspace(0, 1, steps + 1)
    likelihood = _likelihood(j, *(x[:, None] for x in (more, less, equal, u, v)))
    return j[np.arange(len(j)), likelihood.argmax(1)]


def reaches(ku: np.ndarray, kv: np.ndarray, nu: np.ndarray, nv: np.ndarray, least: float, step: float = 1e-3) -> np.ndarray:
    """Whether the likeliest Jaccard similarity of each pair of rows is `least` or more.

    The likelihood has one peak, so it tells which side of `least` the peak is on.
    """
    of = _counts(ku, kv, nu, nv)
    u, v = of[3:]
    top = np.minimum(u / v, v / u)
    at = np.full(len(u), least)
    return (top >= least) & (_likelihood(at, *of) >= _likelihood(at - step, *of))
