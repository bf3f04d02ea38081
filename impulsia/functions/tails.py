"""Tail probabilities of the F and chi-squared laws and normal quantiles."""

from __future__ import annotations

import math
from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _fraction(terms, tiny: float = 1e-300) -> float:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) from (a, b) pairs, by Lentz's recursion."""
    f = c = tiny
    d = 0.0
    for a, b in terms:
        d = b + a * d or tiny
        c = b + a / c or tiny
        d = 1 / d
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)

    def terms():
        yield 1.0, 1.0
        m = 0
        while m < 10_000:
            m += 1
            yield -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1)), 1.0
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front * _fraction(terms())


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    """The regularised upper incomplete gamma function of df / 2 at x / 2."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total

    def terms():
        yield 1.0, x + 1 - a
        for i in range(1, 10_000):
            yield -i * (i - a), x + 2 * i + 1 - a

    return front * _fraction(terms())
