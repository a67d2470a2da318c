"""Tail probabilities without a statistics library."""

from __future__ import annotations

import math

import numpy as np


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Closed form for even degrees of freedom."""
    if df % 2:
        raise ValueError("even degrees of freedom only")
    term = total = 1.0
    for k in range(1, df // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def student_t_two_sided(t: float, df: float) -> float:
    return math.nan if math.isnan(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def welch(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    va, vb = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
    if va + vb == 0:
        return math.nan, math.nan
    df = (va + vb) ** 2 / (va**2 / (len(x) - 1) + vb**2 / (len(y) - 1))
    return float((x.mean() - y.mean()) / math.sqrt(va + vb)), float(df)


def mann_whitney_p(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided; exact for small groups without ties, else normal with corrections for ties and continuity."""
    both = np.concatenate([x, y])
    n, m = len(x), len(y)
    _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    u = ranks[:n].sum() - n * (n + 1) / 2
    u = max(u, n * m - u)
    if min(n, m) <= 8 and (counts == 1).all():
        ways = np.zeros((n + 1, n * m + 1))  # ways[k][s]: choices of k first-group items with s wins
        ways[0, 0] = 1
        for item in range(n + m):
            for k in range(min(item + 1, n), 0, -1):
                wins = item - (k - 1)
                if wins <= m:
                    ways[k, wins:] += ways[k - 1, : n * m + 1 - wins]
        return float(min(1.0, 2 * ways[n, int(round(u)) :].sum() / ways[n].sum()))
    size = n + m
    ties = (counts**3 - counts).sum() / (size * (size - 1))
    sd = math.sqrt(n * m / 12 * (size + 1 - ties))
    return 1.0 if sd == 0 else min(1.0, 2 * norm_sf((u - n * m / 2 - 0.5) / sd))


def kolmogorov_p(d: float, n: int) -> float:
    """Two-sided p-value of a one-sample Kolmogorov-Smirnov statistic.

    Exact by powers of Durbin's matrix for n up to 140 and moderate d, else the
    limit law with the usual small-sample shift of its argument.
    """
    if n <= 140 and n * d * d < 7:
        k = int(n * d) + 1
        m, h = 2 * k - 1, k - n * d
        matrix = np.tril(np.ones((m, m)), 1)
        matrix[:, 0] -= h ** np.arange(1, m + 1)
        matrix[-1, :] -= h ** np.arange(m, 0, -1)
        matrix[-1, 0] += max(0.0, 2 * h - 1) ** m
        for i in range(m):
            for j in range(i + 1):
                matrix[i, j] /= math.factorial(i - j + 1)
        power, scale = np.eye(m), 0
        base, base_scale, e = matrix, 0, n
        while e:
            if e & 1:
                power, scale = power @ base, scale + base_scale
            base, base_scale, e = base @ base, 2 * base_scale, e >> 1
            if (top := abs(base).max()) > 1e100:
                base, base_scale = base / top, base_scale + math.log(top)
        log = math.log(max(power[k - 1, k - 1], 1e-300)) + scale + math.lgamma(n + 1) - n * math.log(n)
        return float(min(1.0, max(0.0, 1 - math.exp(min(0.0, log)))))
    z = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if z < 0.2:
        return 1.0
    j = np.arange(1, 101)
    return float(min(1.0, max(0.0, 2 * np.sum((-1.0) ** (j - 1) * np.exp(-2 * j * j * z * z)))))
