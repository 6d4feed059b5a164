"""Column expressions for correlations, their transforms and intervals; nothing here needs Python on executors."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Bound of |r| before atanh, as the results to match use it.
CLIP = 0.999999


def z_of(p: float) -> float:
    """Normal quantile."""
    return NormalDist().inv_cdf(p)


def number(c: Column | str) -> Column:
    """A double, null where the value is missing, NaN or not a number."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null (greatest and least alone would pass over it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def fisher_z(r: Column) -> Column:
    return F.atanh(clip(r, -CLIP, CLIP))


def inv_fisher_z(z: Column) -> Column:
    return F.tanh(z)


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """x and y where neither is missing."""
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation over complete pairs; null without variance (or fewer than two pairs)."""
    x, y = both(x, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def n_pairs(x: Column, y: Column) -> Column:
    return F.count(both(x, y)[0])


def average_rank(order: Column, *partition: Column | str) -> Column:
    """Window: rank with ties given their mean rank."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*partition, order)) - 1) / 2


def corr_interval(r: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Fisher interval of a correlation; null below four pairs."""
    half = z_of(1 - alpha / 2) / F.sqrt(F.when(n > 3, n - 3))
    return F.tanh(fisher_z(r) - half), F.tanh(fisher_z(r) + half)


def disattenuate(r: Column, reliability: Column) -> Column:
    """r / sqrt(reliability); null for a reliability of at most 0.01 or a result of 1 and more."""
    out = F.when(reliability > 0.01, r / F.sqrt(reliability))
    return F.when(F.abs(out) < 1, out)


def delta_r_interval(r1: Column, n1: Column, r2: Column, n2: Column, alpha: float = 0.05) -> tuple[Column, Column, Column]:
    """Difference of two independent Fisher z with its interval."""
    d = fisher_z(r1) - fisher_z(r2)
    half = z_of(1 - alpha / 2) * F.sqrt(1 / (n1 - 3) + 1 / (n2 - 3))
    return d, d - half, d + half


def min_detectable_delta_z(n1: Column, n2: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    return (z_of(1 - alpha / 2) + z_of(power)) * F.sqrt(1 / (n1 - 3) + 1 / (n2 - 3))


def expected_random_set_correlation(k: Column, rho: Column) -> Column:
    """Spearman-Brown form: k rho / (1 + (k - 1) rho)."""
    return F.try_divide(k * rho, 1 + (k - 1) * rho)


def mean_percentile(observed: Column, null: Column) -> Column:
    """Aggregate: percentile of observed in null values, the mean of the strict and the weak one."""
    null = F.when(~F.isnan(null), null)
    below = F.sum(F.when(null < observed, 1).when(null.isNotNull(), 0))
    upto = F.sum(F.when(null <= observed, 1).when(null.isNotNull(), 0))
    return F.try_divide(100.0 * (below + upto), 2 * F.count(null))


def hash_order(*parts: Column | str | int) -> Column:
    """A reproducible random order: md5 of the parts joined by bars. Any engine with md5 gives the same."""
    return F.md5(F.concat_ws("|", *(F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts)))
