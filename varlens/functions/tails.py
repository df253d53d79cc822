"""Tail probabilities for test statistics (math only; SciPy is not assumed).

These run on the few rows of a test result (one row per test), applied as a
vectorised pandas UDF or on the driver after the statistic has been computed
by Spark.  Standard numerical methods: erfc for the normal, continued
fractions for the regularised incomplete beta and gamma functions, Gauss-
Legendre quadrature for the studentised range.
"""

from __future__ import annotations

import math


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_sf(t: float, df: float) -> float:
    """P(T > t) for Student's t."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    p = 0.5 * betainc(df / 2.0, 0.5, x)
    return p if t > 0 else 1.0 - p


def t_two_sided(t: float, df: float) -> float:
    return min(1.0, 2.0 * t_sf(abs(t), df))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 3e-16:
                break
        return 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > tiny else tiny
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    return gammainc_upper(df / 2.0, x / 2.0)


def _gauss_legendre(n: int):
    xs, ws = [], []
    for i in range(1, n + 1):
        z = math.cos(math.pi * (i - 0.25) / (n + 0.5))
        for _ in range(100):
            p1, p2 = 1.0, 0.0
            for j in range(1, n + 1):
                p1, p2 = ((2 * j - 1) * z * p1 - (j - 1) * p2) / j, p1
            pp = n * (z * p1 - p2) / (z * z - 1.0)
            z1, z = z, z - p1 / pp
            if abs(z - z1) < 1e-15:
                break
        xs.append(z)
        ws.append(2.0 / ((1.0 - z * z) * pp * pp))
    return xs, ws


_GL = _gauss_legendre(64)


def _phi(x: float) -> float:
    return math.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi)


def _Phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def studentized_range_sf(q: float, k: int) -> float:
    """P(Q > q) for the range of k standard normals (infinite df):
    1 - k * integral phi(z) [Phi(z) - Phi(z - q)]^(k-1) dz."""
    if q <= 0:
        return 1.0
    lo, hi = -8.0, 8.0 + q
    xs, ws = _GL
    total = 0.0
    # split the range for accuracy
    cuts = [lo + (hi - lo) * i / 8 for i in range(9)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        h, m = (b - a) / 2.0, (b + a) / 2.0
        for x, w in zip(xs, ws):
            z = m + h * x
            total += w * h * _phi(z) * (_Phi(z) - _Phi(z - q)) ** (k - 1)
    return max(0.0, min(1.0, 1.0 - k * total))


def wilcoxon_exact_sf(w_plus: float, n: int) -> float:
    """Exact two-sided p for the signed-rank statistic (no ties, no zeros):
    distribution of the positive rank sum by dynamic programming over n."""
    max_s = n * (n + 1) // 2
    counts = [0] * (max_s + 1)
    counts[0] = 1
    for r in range(1, n + 1):
        for s in range(max_s, r - 1, -1):
            counts[s] += counts[s - r]
    total = 2 ** n
    w = min(w_plus, max_s - w_plus)
    cdf = sum(counts[: int(math.floor(w)) + 1]) / total
    return min(1.0, 2.0 * cdf)
