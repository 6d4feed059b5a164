"""The dominant common axis of a matrix, and residuals after removing it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import both, n_pairs, pearson
from . import spectra
from .scoring import z_scores


def global_axis_mean_z(expr: DataFrame) -> DataFrame:
    """``sample, axis``: mean z over all genes."""
    return z_scores(expr).groupBy("sample").agg(F.avg("z").alias("axis"))


def global_axis_pc1(expr: DataFrame, groups: DataFrame | None = None, min_group: int = 10) -> DataFrame:
    """``sample, group, axis, variance_explained``: first principal component scores of the z-scored matrix.

    With groups (``sample, group``), each group is standardised and decomposed on its own and groups below
    min_group are left out. The axis correlates positively with the mean z. No task holds a group: samples' z are rows,
    see :mod:`.spectra`. Missing z, and genes without variance in a group, count as 0.
    """
    g = groups if groups is not None else expr.select("sample").distinct().withColumn("group", F.lit("all"))
    least = min_group if groups is not None else 2
    long = expr.join(g.select("sample", F.col("group").cast("string").alias("group")), "sample").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    m = long.groupBy("group", "gene").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s")).filter("_s > 0")
    z = long.join(m, ["group", "gene"], "left").select("group", "sample", "gene", ((F.col("value") - F.col("_m")) / F.col("_s")).alias("z"))
    rows = spectra.as_vectors(z, m.select("group", "gene"))
    held = rows.persist()
    try:
        found = {x: a for x, a in spectra.about(held).items() if a[0] >= least and a[2] and a[1] > 0}
        lead = spectra.leading(held, {x: k for x, (_, _, k) in found.items()})
    finally:
        held.unpersist()
    return spectra.project(rows, {x: v for x, (_, v) in lead.items()}, {x: value / found[x][1] for x, (value, _) in lead.items()}, "axis", "variance_explained")


def top_loadings(expr: DataFrame, axis: DataFrame, n: int = 30) -> DataFrame:
    """``gene, loading``: the genes whose z correlates most with the axis, by absolute value (ties by gene)."""
    r = z_scores(expr).join(axis.select("sample", "axis"), "sample").groupBy("gene").agg(pearson(F.col("z"), F.col("axis")).alias("loading"))
    return r.filter("loading IS NOT NULL").orderBy(F.desc(F.abs("loading")), "gene").limit(n)


def residualise(scores: DataFrame, axis: DataFrame, within: str | None = None, min_rows: int = 5, key: str = "set_name") -> DataFrame:
    """scores with ``residual``: what a least-squares line on the axis leaves, by set (and group).

    Complete pairs only; null for groups with fewer than min_rows. The line's two coefficients come from one
    partial aggregate for each set and group.
    """
    keys = [key, within] if within else [key]
    j = with_axis(scores, axis, within)
    return off_line(j, lines(j, keys), keys, min_rows)


def with_axis(scores: DataFrame, axis: DataFrame, within: str | None = None) -> DataFrame:
    """scores with ``axis`` (and the group, if they don't have it) of their samples."""
    return scores.join(axis.select(*[c for c in ("sample", "axis", within) if c and (c not in scores.columns or c == "sample")]), "sample", "left")


def lines(j: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The least-squares lines of ``score`` on ``axis`` by keys, one small row for each."""
    y, x = both(F.col("score"), F.col("axis"))
    return j.groupBy(*keys).agg(n_pairs(F.col("score"), F.col("axis")).alias("_n"), F.regr_slope(y, x).alias("_b"), F.avg(y).alias("_my"), F.avg(x).alias("_mx"))


def off_line(j: DataFrame, fit: DataFrame, keys: Sequence[str], min_rows: int = 5, how: str = "inner") -> DataFrame:
    """j with ``residual``: its score less that of its :func:`lines`."""
    line = F.col("_my") + F.coalesce("_b", F.lit(0.0)) * (F.col("axis") - F.col("_mx"))
    out = j.join(fit, list(keys), how).withColumn("residual", F.when(F.col("_n") >= min_rows, F.col("score") - line))
    return out.drop("_n", "_b", "_my", "_mx")


def residual_item_variances(expr: DataFrame, axis: DataFrame, within: str | None = None, min_rows: int = 3) -> DataFrame:
    """``gene, variance``: variance (n - 1) of each gene's residuals; null for fewer than two."""
    long = expr.select("sample", F.col("gene").alias("set_name"), F.col("value").alias("score"))
    r = residualise(long, axis, within, min_rows)
    return r.groupBy(F.col("set_name").alias("gene")).agg(F.when(F.count("residual") >= 2, F.var_samp("residual")).alias("variance"))


def three_way(scores: DataFrame, axis: DataFrame, prediction: DataFrame, within: str | None = None, min_n: int = 10) -> DataFrame:
    """``set_name, r_raw, r_axis, r_residual, n``: the prediction's correlation with the score, with the axis, and
    with the score's residual on it. prediction: ``sample, prediction`` (and ``set_name`` for one of each set).
    Correlations over fewer than min_n pairs are null."""
    keys = ["sample", "set_name"] if "set_name" in prediction.columns else ["sample"]
    r = residualise(scores, axis, within).join(prediction, keys)
    p = F.col("prediction")

    def corr(x: Column) -> Column:
        return F.when(n_pairs(x, p) >= min_n, pearson(x, p))

    return r.groupBy("set_name").agg(corr(F.col("score")).alias("r_raw"), corr(F.col("axis")).alias("r_axis"), corr(F.col("residual")).alias("r_residual"), F.count("*").alias("n"))
