"""Batch effects: location and scale correction by site, and how well site itself can be predicted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import count_parts
from ..functions.stats import average_rank
from . import logistic
from .groups import rank_auc
from .ridge import feature_means


def fit_combat(long: DataFrame, min_rows: int = 3) -> DataFrame:
    """``dim, batch, mu, sd, grand_mu, grand_sd`` of ``key, batch, dim, value`` (n denominators; sd 0 counts as 1).

    Batches with fewer than min_rows rows have no parameters.
    """
    one = lambda c: F.when(c > 0, c).otherwise(1.0)
    own = long.groupBy("dim", "batch").agg(F.avg("value").alias("mu"), one(F.stddev_pop("value")).alias("sd"), F.count("*").alias("n")).filter(F.col("n") >= min_rows).drop("n")
    grand = long.groupBy("dim").agg(F.avg("value").alias("grand_mu"), one(F.stddev_pop("value")).alias("grand_sd"))
    return own.join(grand, "dim")


def apply_combat(long: DataFrame, parameters: DataFrame) -> DataFrame:
    """long with ``corrected`` and ``estimable``; batches without parameters stay as they are."""
    j = long.join(parameters, ["dim", "batch"], "left")
    fixed = (F.col("value") - F.col("mu")) / F.col("sd") * F.col("grand_sd") + F.col("grand_mu")
    return j.select(*(long[c] for c in long.columns), F.coalesce(fixed, F.col("value")).alias("corrected"), F.col("mu").isNotNull().alias("estimable"))


def combat(long: DataFrame) -> DataFrame:
    """Fit and apply on the same rows: a description only, since each row takes part in its own correction."""
    return apply_combat(long, fit_combat(long))


def combat_out_of_fold(long: DataFrame, n_folds: int, min_rows: int = 3) -> DataFrame:
    """Each fold corrected with parameters of the other folds. long also has ``fold``.

    Moments are added up once by dimension, batch and fold, about the dimension's mean; those of the other folds are
    the total minus a fold's own. Batches with fewer than min_rows other rows have no parameters.
    """
    centre = long.groupBy("dim").agg(F.avg("value").alias("_c"))
    d = F.col("value") - F.col("_c")
    cells = long.join(centre, "dim").groupBy("dim", "batch", "fold").agg(F.count("value").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"), F.max("_c").alias("_c"))

    def others(by: list[str], name: str) -> DataFrame:
        """Mean and deviation of the rows outside each fold."""
        folds = long.select("fold").distinct()
        own = cells.groupBy(*by, "fold").agg(*(F.sum(x).alias(x) for x in ("n", "s", "ss")), F.max("_c").alias("_c"))
        total = own.groupBy(*by).agg(*(F.sum(x).alias(f"t{x}") for x in ("n", "s", "ss")), F.max("_c").alias("_c"))
        j = total.join(F.broadcast(folds)).join(own.drop("_c"), [*by, "fold"], "left")  # folds are few
        n, s, ss = (F.col(f"t{x}") - F.coalesce(F.col(x), F.lit(0)) for x in ("n", "s", "ss"))
        sd = F.sqrt(F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0)))
        return j.filter(n > 0).select(*by, "fold", n.alias(f"n_{name}"), (F.col("_c") + s / n).alias(f"{name}_mu"), F.when(sd > 1e-12, sd).otherwise(1.0).alias(f"{name}_sd"))

    own = others(["dim", "batch"], "own").filter(F.col("n_own") >= min_rows)
    j = long.join(own, ["dim", "batch", "fold"], "left").join(others(["dim"], "grand"), ["dim", "fold"], "left")
    fixed = (F.col("value") - F.col("own_mu")) / F.col("own_sd") * F.col("grand_sd") + F.col("grand_mu")
    return j.select(*(long[c] for c in long.columns), F.coalesce(fixed, F.col("value")).alias("corrected"), F.col("own_mu").isNotNull().alias("estimable"))


def auroc(scored: DataFrame, site: str = "site") -> DataFrame:
    """``site, n_patients, auroc`` of ``site, label, score`` from average ranks."""
    ranked = scored.withColumn("_r", average_rank(F.col("score"), site))
    return ranked.groupBy(site).agg(F.sum("label").cast("long").alias("n_patients"), rank_auc(F.col("label"), F.col("_r")).alias("auroc"))


def site_prediction_control(frame: DataFrame, n_folds: int = 5, min_site_n: int = 20, c: float = 1.0) -> DataFrame:
    """``site, n_patients, auroc``: one-against-rest logistic models of site from ``key, site, fold, x``.

    Sites with min_site_n patients each get a model for each fold, learnt from the rows of the others; the features are scaled by fold.
    All models are fitted by common scans of the rows, see :mod:`.logistic`. Sites with fewer than 5 rows of either kind, folds with
    fewer than 2 positives to learn from, and sites with fewer than 20 predictions are left out. Rows without a site count as of no site.
    """
    kind = dict(frame.dtypes)["site"]
    held = frame.select(F.col("site").alias("label"), F.col("fold").cast("long").alias("fold"), "x").persist()
    counts: dict[object, dict[int, int]] = {}
    in_fold: dict[int, int] = {}
    for r in held.groupBy("label", "fold").agg(F.count("*").alias("n")).collect():  # sites x folds
        in_fold[r["fold"]] = in_fold.get(r["fold"], 0) + r["n"]
        if r["label"] is not None:
            counts.setdefault(r["label"], {})[r["fold"]] = r["n"]
    total = sum(in_fold.values())
    wanted = []
    for site, own in sorted(counts.items()):
        n = sum(own.values())
        if n < min_site_n or n < 5 or total - n < 5:
            continue
        folds = [k for k in range(n_folds) if n - own.get(k, 0) >= 2 and in_fold.get(k) and total - in_fold[k] > n - own.get(k, 0)]
        if sum(in_fold[k] for k in folds) >= 20:
            wanted += [(site, k, (n - own.get(k, 0)) / (total - in_fold[k])) for k in folds]
    if not wanted:
        held.unpersist()
        return frame.sparkSession.createDataFrame([], f"site {kind}, n_patients long, auroc double")
    try:
        centre, n_parts = feature_means(held), count_parts(held)
        models = logistic.fit(held, wanted, logistic.fold_products(held, centre, n_parts), centre, n_parts, c)
    finally:
        held.unpersist()
    return auroc(logistic.score_rows(frame.select(F.col("site").alias("label"), F.col("fold").cast("long").alias("fold"), "x"), models, kind))


def site_prediction_control_oof_combat(frame: DataFrame, n_folds: int = 5, min_site_n: int = 20, min_rows: int = 3) -> DataFrame:
    """:func:`site_prediction_control` of features corrected out of fold, with ``estimable``: the share of a site's patients whose
    correction could be estimated from other folds. Where it is small, an AUROC near that without correction says nothing.
    """
    long = frame.select("key", F.col("site").alias("batch"), "fold", F.posexplode("x").alias("dim", "value"))
    fixed = combat_out_of_fold(long, n_folds, min_rows)
    rows = fixed.groupBy("key", "batch", "fold").agg(F.array_sort(F.collect_list(F.struct("dim", "corrected"))).alias("v"), F.min(F.col("estimable").cast("int")).alias("e"))
    share = rows.groupBy(F.col("batch").alias("site")).agg(F.avg("e").alias("estimable"))
    corrected = rows.select("key", F.col("batch").alias("site"), "fold", F.transform("v", lambda e: e["corrected"]).alias("x"))
    return site_prediction_control(corrected, n_folds, min_site_n).join(share, "site")
