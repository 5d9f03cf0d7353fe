"""Tail probabilities and small-sample numerics that run on the driver, on a few hundred numbers at most."""

from __future__ import annotations

import math

import numpy as np


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * head)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def chi2_sf(x: float, k: int) -> float:
    return gamma_q(k / 2, x / 2)


def chi_square_uniform(counts: list[float]) -> tuple[float, float]:
    """Statistic and p-value against equal counts."""
    c = np.asarray(counts, float)
    if len(c) < 2 or c.sum() == 0:
        return 0.0, 1.0
    e = c.mean()
    x = float(((c - e) ** 2 / e).sum())
    return x, chi2_sf(x, len(c) - 1)


def skew_test(sample: list[float]) -> tuple[float, float]:
    """D'Agostino's test of skewness."""
    x = np.asarray(sample, float)
    n = len(x)
    if n < 8 or x.std() == 0:
        return float("nan"), float("nan")
    m = x - x.mean()
    b = (m**3).mean() / (m**2).mean() ** 1.5
    y = b * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2 / (w2 - 1))
    y = y or 1.0
    z = delta * math.log(y / alpha + math.sqrt((y / alpha) ** 2 + 1))
    return z, 2 * normal_sf(abs(z))


def kurtosis_test(sample: list[float]) -> tuple[float, float]:
    """Anscombe and Glynn's test of kurtosis."""
    x = np.asarray(sample, float)
    n = len(x)
    if n < 20 or x.std() == 0:
        return float("nan"), float("nan")
    m = x - x.mean()
    b = (m**4).mean() / (m**2).mean() ** 2
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    y = (b - e) / math.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    base = (1 - 2 / a) / (1 + y * math.sqrt(2 / (a - 4)))
    z = (1 - 2 / (9 * a) - math.copysign(abs(base) ** (1 / 3), base)) / math.sqrt(2 / (9 * a))
    return z, 2 * normal_sf(abs(z))


def normal_test(sample: list[float]) -> tuple[float, float]:
    a, b = skew_test(sample)[0], kurtosis_test(sample)[0]
    k2 = a * a + b * b
    return k2, math.exp(-k2 / 2) if k2 == k2 else float("nan")


def ks_sf(d: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    lam = d * math.sqrt(n * m / (n + m))
    if lam < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))))


def kde(sample: list[float], points: int, lo: float, hi: float) -> list[tuple[float, float]]:
    """A Gaussian kernel density with Scott's bandwidth at equally spaced points."""
    x = np.asarray(sample, float)
    at = np.linspace(lo, hi, points)
    width = x.std(ddof=1) * len(x) ** -0.2 if len(x) > 1 else 0
    if not width:
        return [(float(a), 0.0) for a in at]
    z = (at[:, None] - x[None, :]) / width
    y = np.exp(-z * z / 2).sum(1) / (len(x) * width * math.sqrt(2 * math.pi))
    return list(zip(at.tolist(), y.tolist(), strict=True))


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float, int]]:
    """UPGMA over a small square matrix of distances: merges (i, j, distance, size), new clusters numbered on from the last leaf."""
    n = len(distance)
    live = {i: 1 for i in range(n)}
    d = {(i, j): float(distance[i, j]) for i in range(n) for j in range(i + 1, n)}
    out = []
    for new in range(n, 2 * n - 1):
        (i, j), h = min(d.items(), key=lambda x: (x[1], x[0]))
        a, b = live.pop(i), live.pop(j)
        out.append((i, j, h, a + b))
        for k in live:
            x, y = d.pop((min(i, k), max(i, k))), d.pop((min(j, k), max(j, k)))
            d[k, new] = (a * x + b * y) / (a + b)
        del d[i, j]
        live[new] = a + b
    return out
