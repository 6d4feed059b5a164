"""Scores of feature sets over a long sample x gene matrix, and the reliability of such scores.

The matrix is ``sample, gene, value``, sets are ``set_name, gene``; observed and random sets go through one plan
as different set names. A missing value is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import count_parts
from ..functions.stats import average_rank, clip, hash_order, pearson
from . import spectra


def z_scores(expr: DataFrame) -> DataFrame:
    """``sample, gene, z``: values standardised by gene over samples (n - 1); null without variance.

    Moments come from a partial aggregate, one small row for each gene, joined back.
    """
    m = expr.groupBy("gene").agg(F.avg("value").alias("_m"), F.nullif(F.stddev_samp("value"), F.lit(0.0)).alias("_s"))
    return expr.join(m, "gene").select("sample", "gene", ((F.col("value") - F.col("_m")) / F.col("_s")).alias("z"))


def score_mean_z(expr: DataFrame, sets: DataFrame) -> DataFrame:
    """``sample, set_name, score``: mean z of the members that have one; sets without members have no rows."""
    return z_scores(expr).join(sets.select("set_name", "gene"), "gene").groupBy("sample", "set_name").agg(F.avg("z").alias("score"))


def ssgsea_tables(expr: DataFrame, alpha: float = 0.25, ordinal: str = "gene") -> DataFrame:
    """``sample, gene, w, d, n``: rank weights, depth in the descending order (ties by ordinal), and genes of the sample."""
    by_sample = Window.partitionBy("sample")
    rank = average_rank(F.col("value"), "sample")
    place = F.row_number().over(by_sample.orderBy(F.desc("value"), F.col(ordinal)))
    n = F.count("*").over(by_sample)
    return expr.select("sample", "gene", F.pow(F.abs(rank), alpha).alias("w"), (n - place + 1).alias("d"), n.alias("n"))


def score_ssgsea(expr: DataFrame, sets: DataFrame, alpha: float = 0.25, ordinal: str = "gene") -> DataFrame:
    """Single-sample enrichment by its closed form over the members alone.

    With n genes and k members the running sum's integral is
    (sum w d / sum w - (n (n + 1) / 2 - sum d) / (n - k)) / n; null where a member weight or the rest is empty.
    """
    member = ssgsea_tables(expr, alpha, ordinal).join(sets.select("set_name", "gene"), "gene")
    g = member.groupBy("sample", "set_name").agg(F.sum(F.col("w") * F.col("d")).alias("wd"), F.sum("w").alias("sw"), F.sum("d").alias("sd"), F.count("*").alias("k"), F.max("n").alias("n"))
    rest = F.try_divide(F.col("n") * (F.col("n") + 1) / 2 - F.col("sd"), F.col("n") - F.col("k"))
    return g.select("sample", "set_name", ((F.try_divide("wd", "sw") - rest) / F.col("n")).alias("score"))


def score_plage(expr: DataFrame, sets: DataFrame) -> DataFrame:
    """Leading left singular vector of each set's standardised block, signed so that it rises with mean z.

    Genes with a missing z drop out. A set's block meets in no task: each adds up cross products of its own rows, see
    :mod:`.spectra`, and a sample's score is its z times the eigenvector over the singular value.
    """
    z = z_scores(expr).join(sets.select(F.col("set_name").alias("group"), "gene"), "gene").select("group", "sample", "gene", F.when(~F.isnan("z"), F.col("z")).alias("z"))
    per_gene = z.groupBy("group", "gene").agg(F.count("z").alias("_have"))
    of_set = z.groupBy("group", "sample").agg(F.lit(1).alias("_one")).groupBy("group").agg(F.count("*").alias("_n"))
    whole = per_gene.join(of_set, "group").filter("_have = _n").select("group", "gene")
    rows = spectra.as_vectors(z, whole)
    held = rows.persist()
    try:
        lead = spectra.leading(held, {g: k for g, (_, t, k) in spectra.about(held).items() if k and t > 0})
    finally:
        held.unpersist()
    scored = spectra.project(rows, {g: v / value**0.5 for g, (value, v) in lead.items()}, dict.fromkeys(lead, 0.0), "score", "_none")
    return scored.select("sample", F.col("group").alias("set_name"), "score")


SCORERS = {"mean_z": score_mean_z, "ssgsea": score_ssgsea, "plage": score_plage}


def score_sets(expr: DataFrame, sets: DataFrame, scorer: str = "mean_z") -> DataFrame:
    if scorer not in SCORERS:
        raise ValueError(f"no scorer {scorer!r}; there are {sorted(SCORERS)}")
    return SCORERS[scorer](expr, sets)


def _complete_block(expr: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_name, sample, gene, value, k`` of the samples that have all of a set's genes."""
    x = expr.filter("value IS NOT NULL").join(sets.select("set_name", "gene"), "gene")
    k = x.groupBy("set_name").agg(F.countDistinct("gene").alias("k"))
    full = x.groupBy("set_name", "sample").agg(F.count("*").alias("have")).join(k, "set_name").filter("have = k")
    return x.join(full.select("set_name", "sample", "k"), ["set_name", "sample"])


def pairwise_correlation(expr: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_name, k, n, rho``: mean correlation of a set's gene pairs over complete samples.

    The variance of the sum of k standardised genes is k + k (k - 1) rho, so no pair is formed. Null for k < 2
    or n < 5.
    """
    b = _complete_block(expr, sets)
    m = b.groupBy("set_name", "gene").agg(F.avg("value").alias("_m"), F.nullif(F.stddev_samp("value"), F.lit(0.0)).alias("_s"))
    z = b.join(m, ["set_name", "gene"]).withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s"))
    total = z.groupBy("set_name", "sample").agg(F.sum("z").alias("t"), F.max("k").alias("k"))
    g = total.groupBy("set_name").agg(F.max("k").alias("k"), F.count("*").alias("n"), F.var_samp("t").alias("v"))
    ok = (F.col("k") >= 2) & (F.col("n") >= 5)
    return g.select("set_name", "k", "n", F.when(ok, F.try_divide(F.col("v") - F.col("k"), F.col("k") * (F.col("k") - 1))).alias("rho"))


def alpha_of(k: Column, rho: Column) -> Column:
    """Standardised alpha from a mean correlation; 0 where that isn't positive."""
    return F.when(rho <= 0, 0.0).otherwise(k * rho / (1 + (k - 1) * rho))


def cronbach_alpha(expr: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_name, k, n, rho, alpha``."""
    return pairwise_correlation(expr, sets).withColumn("alpha", alpha_of(F.col("k"), F.col("rho")))


def alpha_from_scores(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """``set_name, k, n, alpha`` from raw mean-z scores: rho = (k^2 sum s^2 / (n - 1) - k) / (k (k - 1))."""
    g = scores.groupBy("set_name").agg(F.sum(F.col("score") * F.col("score")).alias("ss"), F.count("score").alias("n")).join(sizes.select("set_name", "k"), "set_name")
    rho = F.try_divide(F.col("k") * F.col("k") * F.try_divide(F.col("ss"), F.col("n") - 1) - F.col("k"), F.col("k") * (F.col("k") - 1))
    return g.select("set_name", "k", "n", F.when((F.col("k") >= 2) & (F.col("n") >= 5), alpha_of(F.col("k"), rho)).alias("alpha"))


def alpha_from_item_variances(scores: DataFrame, sets: DataFrame, variances: DataFrame) -> DataFrame:
    """``set_name, k, alpha``: k / (k - 1) (1 - sum of item variances / (k^2 var(score))), within 0 and 1."""
    items = sets.select("set_name", "gene").join(variances.filter("variance IS NOT NULL"), "gene").groupBy("set_name").agg(F.count("*").alias("k"), F.sum("variance").alias("sv"))
    s = scores.groupBy("set_name").agg(F.var_samp("score").alias("v"), F.count("score").alias("n"))
    j = items.join(s, "set_name")
    denom = F.col("k") * F.col("k") * F.col("v")
    raw = F.col("k") / F.when(F.col("k") > 1, F.col("k") - 1) * (1 - F.when(denom > 0, F.col("sv") / denom))
    return j.select("set_name", "k", F.when((F.col("k") >= 2) & (F.col("n") >= 5), clip(raw, 0.0, 1.0)).alias("alpha"))


def random_halves(sets: DataFrame, n_splits: int = 50, seed: int = 0) -> DataFrame:
    """``set_name, split, half, gene``: each set's genes in a hash order, cut in the middle, for each split."""
    draws = sets.select("set_name", "gene", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split"))
    w = Window.partitionBy("set_name", "split")
    place = F.row_number().over(w.orderBy(hash_order(seed, "set_name", "split", "gene"), "gene"))
    half = F.when(place <= F.floor(F.count("*").over(w) / 2), 0).otherwise(1)
    return draws.select("set_name", "split", half.alias("half"), "gene", F.count("*").over(w).alias("k"))


def split_half_reliability(expr: DataFrame, sets: DataFrame, n_splits: int = 50, seed: int = 0, scorer: str = "mean_z", residualise=None) -> DataFrame:
    """``set_name, r_half, reliability``: median correlation of the halves' scores over splits, stepped up by
    2 r / (1 + r) and kept within 0 and 1. Sets of fewer than 4 genes, and splits of fewer than 10 samples, give null.
    All halves of all splits and sets are scored in one plan.
    """
    halves = random_halves(sets, n_splits, seed).filter("k >= 4")
    named = halves.select(F.concat_ws("|", "set_name", "split", "half").alias("set_name"), "gene")
    scored = score_sets(expr, named, scorer)
    if residualise is not None:
        scored = residualise(scored)
    part = F.split("set_name", "[|]")
    s = scored.select("sample", F.array_join(F.slice(part, 1, F.size(part) - 2), "|").alias("name"), F.element_at(part, -2).cast("int").alias("split"), F.element_at(part, -1).alias("half"), "score")
    pairs = s.groupBy("name", "split", "sample").agg(F.max(F.when(F.col("half") == "0", F.col("score"))).alias("a"), F.max(F.when(F.col("half") == "1", F.col("score"))).alias("b"))
    r = pairs.groupBy("name", "split").agg(pearson(F.col("a"), F.col("b")).alias("r"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n")).filter("n >= 10")
    m = r.groupBy("name").agg(F.median("r").alias("r_half"))
    step = F.try_divide(2 * F.col("r_half"), 1 + F.col("r_half"))
    return m.select(F.col("name").alias("set_name"), "r_half", clip(step, 0.0, 1.0).alias("reliability"))


def one_factor_omega(r: np.ndarray, iterations: int = 500) -> float:
    """McDonald's omega of a correlation matrix from a one-factor maximum likelihood model, by expectation and maximisation."""
    values, vectors = np.linalg.eigh(r)
    load = vectors[:, -1] * np.sqrt(values[-1])
    unique = np.clip(1 - load**2, 0.005, 1)
    for _ in range(iterations):
        beta = (load / unique) / (1 + np.sum(load**2 / unique))
        rb = r @ beta
        new = rb / (1 - beta @ load + beta @ rb)
        unique = np.clip(1 - new * rb, 0.005, None)
        moved, load = np.abs(new - load).max(), new
        if moved < 1e-10:
            break
    return float(load.sum() ** 2 / (load.sum() ** 2 + unique.sum()))


def omega_reliability(expr: DataFrame, sets: DataFrame, iterations: int = 500) -> DataFrame:
    """``set_name, k, omega``: McDonald's omega from a one-factor maximum likelihood model of each set's correlations.

    Over the samples that have all of a set's genes; genes without variance drop out. Null below 3 genes or 5 samples. Correlations are
    cross products added up over tasks; a task sees k x k numbers of a set. Sets of more than 1,024 genes raise.
    """
    b = _complete_block(expr, sets)
    m = b.groupBy("set_name", "gene").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = b.join(m, ["set_name", "gene"]).select(F.col("set_name").alias("group"), "sample", "gene", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).alias("z"))
    rows = spectra.as_vectors(z, m.filter("_s > 0").select(F.col("set_name").alias("group"), "gene")).persist()
    try:
        found = spectra.about(rows)
        if large := [g for g, (_, _, k) in found.items() if k > spectra.GRAM_MEMBERS]:
            raise ValueError(f"sets of more than {spectra.GRAM_MEMBERS} genes: {large[:5]}")
        fit = {g: k for g, (n, _, k) in found.items() if k >= 3 and n >= 5}
        counts = {g: n for g, (n, _, _) in found.items()}

        def solve(table: pa.Table) -> pa.Table:
            r = spectra.matrix_of(table)
            return pa.table({"set_name": table["group"][:1], "omega": [one_factor_omega(r / (counts[table["group"][0].as_py()] - 1), iterations)]})

        omega = {r["set_name"]: r["omega"] for r in spectra.cross_products(rows, fit, count_parts(rows)).groupBy("group").applyInArrow(solve, "set_name string, omega double").collect()} if fit else {}  # a number for each set
    finally:
        rows.unpersist()
    return expr.sparkSession.createDataFrame([(g, k, omega.get(g)) for g, (_, _, k) in found.items()], "set_name string, k long, omega double")


def tie_audit(expr: DataFrame) -> DataFrame:
    """``sample, n_tied_values, n_tied``: values that several genes of a sample share, and how many genes."""
    ties = expr.groupBy("sample", "value").agg(F.count("*").alias("c"))
    return ties.groupBy("sample").agg(F.count_if(F.col("c") > 1).alias("n_tied_values"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("n_tied"))
