"""numpy kernels: distances, transforms, quadrature, curve parameters."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# Curve parameters (a, b) of common (min_dist, spread).
CURVES = {(0.1, 1.0): (1.577, 0.8951), (0.01, 1.0): (1.929, 0.7915), (0.5, 1.0): (1.120, 1.068)}


def curve_parameters(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^2b): tabulated, else a = 1.5 / spread^1.8 and b = 0.9."""
    for (d, s), found in CURVES.items():
        if abs(d - min_dist) < 1e-6 and abs(s - spread) < 1e-6:
            return found
    return (1.5 / spread**1.8 if min_dist > 0 else CURVES[0.1, 1.0][0]), 0.9


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    x = np.array(x, copy=True)
    n = x.shape[-1]
    if n & (n - 1):
        raise ValueError("the width must be a power of two")
    h = 1
    while h < n:
        y = x.reshape(*x.shape[:-1], -1, 2, h)
        x = np.concatenate([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-1).reshape(x.shape)
        h *= 2
    return x / np.sqrt(np.array(n, x.dtype))


def exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distances of two equally shaped matrices, summed from the first column on."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - y[:, j]
        total += d * d
    return np.sqrt(total)


def nearest(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, skip_same: bool, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, neighbour id, distance) of the k nearest rows of ``x`` for each row of ``q``, ties by id.

    With ``bound``, a distance for each query, rows beyond it are left out.

    A matrix product finds the candidates; whatever its rounding may hide is kept and measured exactly.
    """
    if not len(q) or not len(x) or k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    shift = x.mean(axis=0)
    a, b = q - shift, x - shift
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    near = na[:, None] + nb[None, :] - 2 * (a @ b.T)
    slack = 1e-13 * (x.shape[1] + 8) * (na + nb.max())
    if skip_same:
        near[qid[:, None] == xid[None, :]] = np.inf
    if bound is None:
        m = min(k, len(x))
        worst = np.partition(near, m - 1, axis=1)[:, m - 1] + 2 * slack
    else:
        worst = bound * bound * (1 + 1e-12) + 2 * slack
    row, col = np.nonzero((near <= worst[:, None]) & np.isfinite(near))
    dist = exact_distances(q[row], x[col])
    by = np.lexsort((xid[col], dist, row))
    row, col, dist = row[by], col[by], dist[by]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], xid[col[keep]], dist[keep]


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def sphere_density(x: np.ndarray, d: int) -> np.ndarray:
    """Density of one coordinate of a uniform point on the unit sphere in d dimensions."""
    c = math.exp(math.lgamma(d / 2) - math.lgamma((d - 1) / 2)) / math.sqrt(math.pi)
    inside = np.abs(x) < 1
    return np.where(inside, c * np.power(np.where(inside, 1 - x * x, 1.0), (d - 3) / 2), 0.0)


@lru_cache
def _legendre(degree: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(degree)


def integrate(f, a: np.ndarray, b: np.ndarray, degree: int = 32) -> np.ndarray:
    """Gauss-Legendre integrals of a vectorized function over the intervals [a, b]."""
    x, w = _legendre(degree)
    a, b = np.atleast_1d(a).astype(float), np.atleast_1d(b).astype(float)
    half, mid = (b - a) / 2, (a + b) / 2
    return (f(mid[:, None] + half[:, None] * x[None, :]) * w).sum(axis=1) * half


def by_id(ids: np.ndarray, seed: int, stage: int, width: int) -> np.ndarray:
    """Uniform numbers of [0, 1), one row per id, whatever rows it comes with."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, width + 1, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64((seed * 0x165667B19E3779F9 + stage * 0x27D4EB2F165667C5) % 2**64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / 2**53


def normal_by_id(ids: np.ndarray, seed: int, stage: int, width: int) -> np.ndarray:
    """Standard normal numbers, one row per id (Box-Muller)."""
    u = by_id(ids, seed, stage, 2 * width)
    return np.sqrt(-2 * np.log1p(-u[:, :width])) * np.cos(2 * np.pi * u[:, width:])
