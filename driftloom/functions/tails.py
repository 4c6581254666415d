"""Tail probabilities of the distributions that the tests need, from continued fractions (no SciPy)."""

from __future__ import annotations

import math


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's method."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 2000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 2000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b or tiny)
        c = b + num / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out * math.exp(-x + a * math.log(x) - math.lgamma(a))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def pearson_p(r: float, n: int) -> float:
    if n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def studentised_range_upper(q: float, k: int, steps: int = 2000) -> float:
    """P(range of k standard normals > q), the studentised range with infinitely many degrees of freedom, by Simpson's rule."""
    if q <= 0:
        return 1.0
    lo, hi = -8.0, 8.0 + q
    h = (hi - lo) / steps
    total = 0.0
    for i in range(steps + 1):
        z = lo + i * h
        f = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (normal_cdf(z) - normal_cdf(z - q)) ** (k - 1)
        total += f * (1 if i in (0, steps) else 4 if i % 2 else 2)
    return min(max(1 - k * total * h / 3, 0.0), 1.0)
