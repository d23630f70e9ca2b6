"""Special functions for p-values (pure Python, standard library only).

These run inside pandas UDFs on summary rows (one row per category x metric),
never on raw data. Formulas are the textbook ones:
normal survival via erfc, chi-square(1) survival, exact binomial CDF, the
exact null distributions of the signed-rank and rank-sum statistics by
dynamic programming, and Student-t survival via the regularised incomplete
beta function (Lentz continued fraction).
"""

from __future__ import annotations

import math
from functools import lru_cache


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def two_sided_normal_p(z: float) -> float:
    return min(1.0, 2.0 * norm_sf(abs(z)))


def chi2_1_sf(x: float) -> float:
    """Survival function of chi-square with one degree of freedom."""
    if x <= 0:
        return 1.0
    return math.erfc(math.sqrt(x / 2.0))


def binom_cdf(k: int, n: int, p: float = 0.5) -> float:
    if n == 0:
        return 1.0
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(0, k + 1))


@lru_cache(maxsize=256)
def _signed_rank_counts(n: int) -> tuple[int, ...]:
    """Number of subsets of {1..n} with each rank sum (exact null of W+)."""
    m = n * (n + 1) // 2
    c = [0] * (m + 1)
    c[0] = 1
    for r in range(1, n + 1):
        for s in range(m, r - 1, -1):
            c[s] += c[s - r]
    return tuple(c)


def wilcoxon_exact_p(n: int, t: float) -> float:
    """Two-sided exact p of the signed-rank statistic ``t = min(W+, W-)`` (no ties)."""
    c = _signed_rank_counts(n)
    total = 2 ** n
    k = int(math.floor(t + 1e-9))
    cdf = sum(c[: k + 1]) / total
    return min(1.0, 2.0 * cdf)


@lru_cache(maxsize=256)
def _rank_sum_counts(n1: int, n2: int) -> tuple[int, ...]:
    """Number of arrangements with each value of U (exact null of Mann-Whitney U).

    The counts are the coefficients of the Gaussian binomial [n1+n2 choose m]_q with
    m = min(n1, n2): multiply by (1 - q^(M+i)) and divide by (1 - q^i) for i = 1..m,
    O(m^2 * M) integer operations (m is small whenever the exact null is used).
    """
    m, big = min(n1, n2), max(n1, n2)
    size = m * big + 1
    c = [0] * size
    c[0] = 1
    for i in range(1, m + 1):
        step = big + i
        for k in range(size - 1, step - 1, -1):   # times (1 - q^(big+i))
            c[k] -= c[k - step]
        for k in range(i, size):                  # divided by (1 - q^i)
            c[k] += c[k - i]
    return tuple(c)


def mannwhitney_exact_p(n1: int, n2: int, u1: float) -> float:
    """Two-sided exact p of U (no ties)."""
    c = _rank_sum_counts(n1, n2)
    total = sum(c)
    u = max(u1, n1 * n2 - u1)
    k = int(math.ceil(u - 1e-9))
    sf = sum(c[k:]) / total
    return min(1.0, 2.0 * sf)


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
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
        if abs(de - 1.0) < 3e-16:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return min(1.0, betainc(df / 2.0, 0.5, df / (df + t * t)))
