"""Tails of counts at any size: incomplete gamma and beta functions by continued fractions."""

from __future__ import annotations

import math
from collections.abc import Callable

TINY = 1e-300


def fraction(first: float, terms: Callable[[int], tuple[float, float]]) -> float:
    """first + a1/(b1 + a2/(b2 + ...)), by the modified Lentz method; terms(n) gives (an, bn)."""
    value = first or TINY
    c, d, n = value, 0.0, 0
    while True:
        n += 1
        a, b = terms(n)
        d = b + a * d or TINY
        c = b + a / c or TINY
        d = 1 / d
        value *= c * d
        if abs(c * d - 1) < 1e-15 or n > 10_000_000:
            return value


def gamma_below(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function P(a, x)."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    return max(0.0, 1 - front / fraction(x + 1 - a, lambda n: (-n * (n - a), x + 2 * n + 1 - a)))


def beta_below(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_below(b, a, 1 - x)

    def terms(n: int) -> tuple[float, float]:
        m = n // 2
        if n % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / (a * fraction(1.0, terms))


def at_least(k: int, mean: float, r: float | None) -> float:
    """P(X >= k): Poisson, or with r negative binomial."""
    if k <= 0:
        return 1.0
    return gamma_below(k, mean) if r is None else 1 - beta_below(r, k, r / (r + mean))


def quantile(q: float, mean: float, r: float | None) -> int:
    """The least k with P(X <= k) >= q."""
    high = max(1, int(mean))
    while 1 - at_least(high + 1, mean, r) < q:
        high *= 2
    low = -1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if 1 - at_least(mid + 1, mean, r) >= q else (mid, high)
    return high


def binomial_at_least(k: int, n: int, p: float) -> float:
    """P(X >= k) of n trials."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_below(k, n - k + 1, p)
