"""p-values of columns of statistics, as arrays; missing where a statistic is."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np

_lgamma, _erfc = np.vectorize(math.lgamma, [float]), np.vectorize(math.erfc, [float])


def normal_two_sided(z: np.ndarray | float) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularized, by its continued fraction; x within 0 and 1."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    turn = x > (a + 1) / (a + b + 2)
    a, b, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside)) / a
    tiny = 1e-300
    safe = lambda v: np.where(v == 0, tiny, v)
    c, d = np.ones_like(y), 1 / safe(1 - (a + b) * y / (a + 1))
    f = d.copy()
    for m in range(1, 500):
        for k in (m * (b - m) * y / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * y / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + k * d), safe(1 + k / c)
            f = f * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    out = np.where(y <= 0, 0.0, front * f)
    return np.where(turn, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out, ok = np.full(t.shape, np.nan), ~(np.isnan(t) | np.isnan(df))
    if ok.any():
        out[ok] = incomplete_beta(df[ok] / 2, 0.5, df[ok] / (df[ok] + t[ok] * t[ok]))
    return out


def _by_sizes(p, n: np.ndarray, m: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """p(n, m, values...) for each pair of sizes that occurs, over its values."""
    n, m, *rest = (np.atleast_1d(np.asarray(v, float)) for v in (n, m, *rest))
    out, ok = np.full(n.shape, np.nan), ~np.isnan(np.array([n, m, *rest])).any(0)
    for a, b in {*zip(n[ok], m[ok], strict=True)}:
        at = ok & (n == a) & (m == b)
        out[at] = p(int(a), int(b), *(v[at] for v in rest))
    return out


def _ks(n: int, m: int, d: np.ndarray) -> np.ndarray:
    if not n or not m:
        return np.full(d.shape, np.nan)
    if n * m > 10_000:
        k = np.arange(1, 101)[:, None]
        return np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * (n * m / (n + m)) * d * d)).sum(0), 0, 1)
    limit = d - 1e-12
    row = np.zeros((m + 1, len(d)))
    for i in range(n + 1):
        new = np.zeros((m + 1, len(d)))
        for j in range(m + 1):
            paths = 1.0 if i == j == 0 else (row[j] if i else 0.0) * (i / (i + j)) + (new[j - 1] if j else 0.0) * (j / (i + j))
            new[j] = np.where(abs(i / n - j / m) < limit, paths, 0.0)
        row = new
    return 1 - row[m]


def ks_two_sided(d: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Two samples: paths of a lattice that stay within d (exact) up to ten thousand
    cells, the limit distribution beyond."""
    return _by_sizes(_ks, n, m, d)


def _mann_whitney(n: int, m: int, u: np.ndarray, ties: np.ndarray) -> np.ndarray:
    if not n or not m:
        return np.full(u.shape, np.nan)
    total = n + m
    sd = np.sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1))))
    p = np.where(sd > 0, np.minimum(normal_two_sided(np.maximum(np.abs(u - n * m / 2) - 0.5, 0) / np.where(sd > 0, sd, 1)), 1), 1.0)
    if min(n, m) > 8:
        return p
    counts = [1] + [0] * (n * m)  # how many orders give each u
    for i in range(1, n + 1):
        for k in range(m + i, n * m + 1)[::-1]:
            counts[k] -= counts[k - m - i]
        for k in range(i, n * m + 1):
            counts[k] += counts[k - i]
    share = np.array(list(accumulate(counts)), float) / math.comb(total, n)
    return np.where(ties == 0, np.minimum(2 * share[np.minimum(u, n * m - u).astype(int)], 1), p)


def mann_whitney_two_sided(u: np.ndarray, n: np.ndarray, m: np.ndarray, ties: np.ndarray | float = 0.0) -> np.ndarray:
    """Exact for small samples without ties, else normal with corrections.  ties:
    the sum of t^3 - t over groups of equals."""
    u = np.atleast_1d(np.asarray(u, float))
    return _by_sizes(_mann_whitney, np.broadcast_to(n, u.shape), np.broadcast_to(m, u.shape), u, np.broadcast_to(ties, u.shape))
