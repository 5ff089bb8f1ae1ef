"""SetSketch: registers of exponentially spaced, truncated minima.

Register j of a set is ``floor(1 - log_b(min over elements of an exponential variate of rate a))``, kept in
0..q+1. Registers of a union are the maxima of the registers, so sketches merge; with a base near 1 the share of
equal registers is close to the Jaccard similarity, so bands of registers are locality-sensitive; and for known
set sizes the counts of larger, smaller and equal registers give the similarity by maximum likelihood.
"""

from __future__ import annotations

import numpy as np

M, BASE, RATE, Q = 240, 1.001, 20.0, 2**16 - 2
BANDS, ROWS = 40, 6
_rng = np.random.default_rng(0x5E7)
_MULT = (_rng.integers(0, 2**32, M, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_XOR = _rng.integers(0, 2**32, M, np.uint64).astype(np.uint32)[:, None]
_CHUNK = 1024
_GRID = np.linspace(0.0, 1.0, 201)


def registers(elements: np.ndarray) -> np.ndarray:
    """uint16 registers of a non-empty set of well-mixed 64-bit hashes."""
    x = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)
    low = np.full(M, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _CHUNK):
        v = x[None, at : at + _CHUNK] ^ _XOR
        v *= _MULT
        np.minimum(low, v.min(axis=1), out=low)
    u = (low.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs (rows of registers) of sets with known sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    pm, pl = _p(u - v * j), _p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        like = np.where(more > 0, more * np.log(pm), 0) + np.where(less > 0, less * np.log(pl), 0) + np.where(same > 0, same * np.log(np.clip(1 - pm - pl, 0, 1)), 0)
    return j[np.arange(len(j)), np.nan_to_num(like, nan=-np.inf).argmax(1)]


def band_keys(regs: np.ndarray) -> list[bytes]:
    return [regs[k * ROWS : (k + 1) * ROWS].tobytes() for k in range(BANDS)]
