"""Quantile functions that thresholds need, on the driver, for a handful of distinct arguments."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _lower_gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction beyond."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi_square_quantile(p: float, degrees: int) -> float:
    """x with P(chi-square of `degrees` <= x) = p, by bisection."""
    if not 0 < p < 1 or degrees < 1:
        raise ValueError("p must lie in (0, 1) and degrees be positive")
    lo, hi = 0.0, float(degrees)
    while _lower_gamma(degrees / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _lower_gamma(degrees / 2, mid / 2) < p else (lo, mid)
        if hi - lo < 1e-13 * max(1.0, hi):
            break
    return (lo + hi) / 2
