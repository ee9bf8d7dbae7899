"""Student t, F, chi-square and normal distributions, from the incomplete beta and gamma functions."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    if math.isnan(t) or df <= 0:
        return math.nan
    return 0.0 if math.isinf(t) else beta_inc(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


def f_upper(f: float, df1: float, df2: float) -> float:
    if math.isnan(f) or df1 <= 0 or df2 <= 0:
        return math.nan
    return 1.0 if f <= 0 else beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def chi2_upper(x: float, df: float) -> float:
    return math.nan if math.isnan(x) or df <= 0 else gamma_upper(df / 2, x / 2)
