"""Distribution functions for a few values on the driver, from the standard library alone."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations
from statistics import NormalDist

_EPS = 1e-15


def two_sided_p(value: float, se: float) -> float:
    """p of a normal statistic; erfc keeps small values exact."""
    return math.erfc(abs(value / se) / math.sqrt(2)) if se > 0 else math.nan


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= (step := c * d)
        if abs(step - 1) < _EPS:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2) if df > 0 else math.nan


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= (step := c * d)
        if abs(step - 1) < _EPS:
            break
    return front * h


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def quantile(cdf: Callable[[float], float], p: float, low: float = 0.0, high: float = 1.0) -> float:
    """Inverse of a distribution on positive numbers, by bisection."""
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def chi2_ppf(p: float, df: float) -> float:
    return quantile(lambda x: 1 - chi2_sf(x, df), p, high=max(1.0, df))


def f_ppf(p: float, d1: float, d2: float) -> float:
    return quantile(lambda x: f_cdf(x, d1, d2), p)


def sd_interval(sd: float, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Chi-square interval of a standard deviation."""
    df = n - 1
    return sd * math.sqrt(df / chi2_ppf(1 - alpha / 2, df)), sd * math.sqrt(df / chi2_ppf(alpha / 2, df))


def sd_ratio_interval(sd1: float, n1: int, sd2: float, n2: int, alpha: float = 0.05) -> tuple[float, float, float]:
    """Ratio of two standard deviations with its F interval."""
    ratio = sd1 / sd2
    return ratio, ratio / math.sqrt(f_ppf(1 - alpha / 2, n1 - 1, n2 - 1)), ratio / math.sqrt(f_ppf(alpha / 2, n1 - 1, n2 - 1))


def normal_power(effect: float, se: float, alpha: float = 0.05) -> float:
    """Power of a two-sided normal test."""
    n = NormalDist()
    crit = n.inv_cdf(1 - alpha / 2)
    return n.cdf(effect / se - crit) + n.cdf(-effect / se - crit)


def hypergeometric_tail(successes: int, population: int, good: int, draws: int) -> float:
    """P(at least so many successes)."""
    total = math.comb(population, draws)
    return sum(math.comb(good, k) * math.comb(population - good, draws - k) for k in range(successes, min(good, draws) + 1) if draws - k <= population - good) / total


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: tables no more likely than this one."""
    n, good, draws = a + b + c + d, a + c, a + b
    p = {k: math.comb(good, k) * math.comb(n - good, draws - k) for k in range(max(0, draws - n + good), min(good, draws) + 1)}
    return sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)) / math.comb(n, draws)


def relabelling_p(values: list[float], chosen: list[bool]) -> tuple[float, float]:
    """Mean difference of chosen and other values, and the share of all relabellings with one as large."""
    k, n = sum(chosen), len(values)
    total = sum(values)
    diff = lambda s: s / k - (total - s) / (n - k)
    seen = diff(sum(v for v, c in zip(values, chosen, strict=True) if c))
    all_ = [diff(sum(values[i] for i in x)) for x in combinations(range(n), k)]
    return seen, sum(d >= seen - 1e-12 for d in all_) / len(all_)


def mann_whitney_p(u: float, n1: int, n2: int, ties: float = 0.0, alternative: str = "two-sided") -> float:
    """p of the Mann-Whitney statistic u of the first group; ``ties`` is the sum of t^3 - t over tied values.

    Exact where a group has at most 8 values and none are tied; else normal, with the tie and continuity corrections.
    """
    if n1 < 1 or n2 < 1:
        return math.nan
    if min(n1, n2) <= 8 and not ties:
        ways = _rank_sum_ways(n1, n2)
        total = sum(ways)
        below, above = sum(ways[: int(u) + 1]) / total, sum(ways[int(u) :]) / total
    else:
        n = n1 + n2
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
        if sd == 0:
            return 1.0
        side = lambda d: 0.5 * math.erfc((d - 0.5) / sd / math.sqrt(2))
        below, above = side(n1 * n2 / 2 - u), side(u - n1 * n2 / 2)
    return {"less": below, "greater": above, "two-sided": min(1.0, 2 * min(below, above))}[alternative]


def _rank_sum_ways(n1: int, n2: int) -> list[int]:
    """In how many ways n1 of n1 + n2 ranks give each value of u."""
    ways = [[1] + [0] * (n1 * n2)] + [[0] * (n1 * n2 + 1) for _ in range(n1)]
    for rank in range(1, n1 + n2 + 1):
        for k in range(min(rank, n1), 0, -1):
            step = rank - k  # values of the other group below this one
            for u in range(n1 * n2, step - 1, -1):
                ways[k][u] += ways[k - 1][u - step]
    return ways[n1]
