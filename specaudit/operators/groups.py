"""Association of labels, and how a prediction's accuracy differs between groups of patients."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dealing import DRAW_STEP, KEYS, deal_key, dealt, dealt_places
from ..functions.ranking import kept, rank_in_order
from ..functions.special import chi2_sf
from ..functions.stats import fisher_z, min_detectable_delta_z, n_pairs, pearson, z_of

#: The reference group, groups that are compared, and the least rows of a cell.
REFERENCE = "EUR"
GROUPS = ("EUR", "AFR", "ASIAN", "AMR")
MIN_CELL = 20
#: Rows of a block of places, and shares of the permutations that tasks take.
BLOCK_ROWS, SHARES = 2_000_000, 24


def cramers_v(frame: DataFrame, x: str, y: str, *keys: str, count: str | None = None) -> DataFrame:
    """``chi2, n, phi2, v, v_corrected`` (by keys): raw and bias-corrected association of two labels; a row may stand for a count of rows.

    The statistic needs only cells that hold rows: chi2 = n (sum of c^2 / (row x column) - 1).
    """
    k = list(keys)
    cells = frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*k, x, y).agg((F.count("*") if count is None else F.sum(count)).alias("c"))
    rows, cols = Window.partitionBy(*k, x), Window.partitionBy(*k, y)
    c = cells.select(*k, x, y, "c", F.sum("c").over(rows).alias("rt"), F.sum("c").over(cols).alias("ct"))
    g = c.groupBy(*k).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c") / (F.col("rt") * F.col("ct"))).alias("s"), F.countDistinct(x).alias("r"), F.countDistinct(y).alias("q"))
    phi2 = F.when(F.col("s") > 1, F.col("s") - 1).when(F.col("s").isNotNull(), 0.0)
    least = F.least(F.col("r"), F.col("q")) - 1
    n1 = F.col("n") - 1
    phi2c = F.greatest(F.lit(0.0), phi2 - F.try_divide((F.col("r") - 1) * (F.col("q") - 1), n1))
    rc = F.col("r") - F.try_divide((F.col("r") - 1) * (F.col("r") - 1), n1)
    qc = F.col("q") - F.try_divide((F.col("q") - 1) * (F.col("q") - 1), n1)
    leastc = F.least(rc, qc) - 1
    return g.select(*k, (phi2 * F.col("n")).alias("chi2"), "n", phi2.alias("phi2"), F.when(least > 0, F.sqrt(phi2 / least)).alias("v"), F.when((least > 0) & (leastc > 0), F.sqrt(phi2c / leastc)).alias("v_corrected"))


def permuted(frame: DataFrame, key: str, label: str, n_perm: int, seed: int = 0, within: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``perm, key, label``, and columns of the row to carry: labels dealt anew among the rows (of each stratum), for each permutation.

    Rows have places in the order of their keys, found once. In each permutation a row takes the label at the image of its place, which a key
    alone gives, so no permutation is sorted.
    """
    by = [within] if within else []
    base = frame.select(F.col(key).alias("_k"), F.col(label).alias("_l"), *by, *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    kept = [f"_c{i}" for i in range(len(carry))]
    own = rank_in_order(base, "_k", name="_p", by=by)
    sizes = base.groupBy(*by).agg(F.count("*").alias("_n"))
    sized = own.join(sizes, by) if by else own.withColumn("_n", F.lit(base.count()))
    many = sized.select(*by, "_k", "_p", "_n", *kept, F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    to = many.select("perm", *by, "_k", *kept, dealt(F.col("_p"), F.col("_n"), deal_key(seed, F.col("perm"), name=F.col(within) if within else None)).alias("_p"))
    return to.join(own.select(*by, "_p", "_l"), [*by, "_p"]).select("perm", F.col("_k").alias(key), F.col("_l").alias(label), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))


def permuted_cells(frame: DataFrame, key: str, label: str, n_perm: int, seed: int = 0, within: str | None = None, other: str | None = None, value: str | None = None) -> DataFrame:
    """``perm, label (, other), n, s``: rows and the sum of a value by the labels of :func:`permuted` (and another label that stays with the row).

    The rows of a permutation never leave their task. Places are cut into blocks, and a task takes a block of rows, a block of labels and
    some of the permutations; it counts the rows whose images lie in the block of labels. What is shuffled are the blocks, once for each
    of SHARES shares of the permutations; a stratum of B blocks computes each image B times.
    """
    kinds = dict(frame.dtypes)
    lit = F.lit(None).cast("int") if other is None else F.col(other)
    base = frame.select(F.col(key).alias("_k"), F.col(label).alias("_l"), (F.lit(0) if within is None else F.col(within)).alias("_w"), lit.alias("_x"), (F.lit(0.0) if value is None else F.col(value).cast("double")).alias("_v"))
    own = kept(rank_in_order(base, "_k", name="_p", by=["_w"]).drop("_k"))
    sizes = own.groupBy("_w").agg(F.count("*").alias("_n")).withColumn("_key", deal_key(seed, F.lit(0), name=None if within is None else F.col("_w")))
    sized = own.join(sizes, "_w")
    shares = min(SHARES, n_perm)
    block = F.floor(F.col("_p") / BLOCK_ROWS).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / BLOCK_ROWS).cast("int")))
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    rows = sized.select("_w", block.alias("_a"), every.alias("_b"), "_p", "_x", "_v", "_n", "_key").select("*", share.alias("_share"))
    labels = sized.select(F.col("_w").alias("_lw"), every.alias("_la"), block.alias("_lb"), F.col("_p").alias("_lp"), F.col("_l").alias("_ll")).select("*", share.alias("_ls"))
    schema = f"perm int, _l {kinds[label]}, _x {'int' if other is None else kinds[other]}, n long, s double"

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            names, xs = (t.combine_chunks().column(c).combine_chunks().dictionary_encode("encode") for t, c in ((right, "_ll"), (left, "_x")))
            first, n, key = right["_lb"][0].as_py() * BLOCK_ROWS, left["_n"][0].as_py(), left["_key"][0].as_py()
            codes = np.full(BLOCK_ROWS, -1, np.int64)
            codes[right["_lp"].to_numpy() - first] = names.indices.to_numpy()
            p, x, v, width = left["_p"].to_numpy(), xs.indices.to_numpy().astype(np.int64), left["_v"].to_numpy(), len(xs.dictionary)
            for perm in range(left["_share"][0].as_py(), n_perm, shares):
                image = np.concatenate([dealt_places(q, np.full(len(q), n), np.full(len(q), (key + perm * DRAW_STEP) % KEYS)) for q in np.array_split(p, -(-len(p) // 200_000))]) - first
                here = np.flatnonzero((image >= 0) & (image < BLOCK_ROWS))
                cell, at = np.unique(codes[image[here]] * width + x[here], return_inverse=True) if len(names.dictionary) * width > 1 << 20 else (None, codes[image[here]] * width + x[here])
                many, sums = np.bincount(at), np.bincount(at, weights=v[here])
                seen = np.flatnonzero(many)
                cell = seen if cell is None else cell[seen]
                out.append((np.full(len(seen), perm, np.int32), names.dictionary.take(pa.array(cell // width)), xs.dictionary.take(pa.array(cell % width)), many[seen], sums[seen]))
        kinds_ = [pa.int32(), right.schema.field("_ll").type, left.schema.field("_x").type, pa.int64(), pa.float64()]
        return pa.table([pa.chunked_array([pa.array(o[i], kinds_[i]) if i not in (1, 2) else o[i] for o in out], kinds_[i]) for i in range(5)], names=["perm", "_l", "_x", "n", "s"])

    cells = rows.groupBy("_w", "_a", "_b", "_share").cogroup(labels.groupBy("_lw", "_la", "_lb", "_ls")).applyInArrow(count, schema)
    return cells.groupBy("perm", F.col("_l").alias(label), *([] if other is None else [F.col("_x").alias(other)])).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def cramers_v_calibrated(frame: DataFrame, x: str, y: str, key: str, n_perm: int = 200, seed: int = 0) -> DataFrame:
    """``v, null_median, null_p95, v_calibrated, perm_p``: association against that of permuted labels."""
    seen = cramers_v(frame, x, y).select("v")
    known = frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    null = cramers_v(permuted_cells(known, key, y, n_perm, seed, other=x), x, y, "perm", count="n").select(F.col("v").alias("nv"))
    j = null.join(F.broadcast(seen.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))  # one row
    g = j.agg(F.max("v").alias("v"), F.median("nv").alias("null_median"), F.percentile("nv", F.lit(0.95)).alias("null_p95"), F.count_if(F.col("nv") >= F.col("v")).alias("ge"), F.count("*").alias("b"))
    return g.select("v", "null_median", "null_p95", (F.col("v") - F.col("null_median")).alias("v_calibrated"), ((1 + F.col("ge")) / (1.0 + F.col("b"))).alias("perm_p"))


def _listed(spark: SparkSession, groups: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(g,) for g in groups], "group string")


def group_correlations(frame: DataFrame, groups: Sequence[str] = GROUPS, min_n: int = MIN_CELL, keys: Sequence[str] = ()) -> DataFrame:
    """``group, n, r, z, se_z, below_min_n`` of ``group, y_true, y_pred``; a row for every group named."""
    k = list(keys)
    g = frame.groupBy(*k, "group").agg(F.count("*").alias("rows"), n_pairs(F.col("y_true"), F.col("y_pred")).alias("pairs"), pearson(F.col("y_true"), F.col("y_pred")).alias("r"))
    named = _listed(frame.sparkSession, groups)
    wanted = frame.select(*k).distinct().join(named, F.lit(True)) if k else named
    j = F.broadcast(wanted).join(g, [*k, "group"], "left") if not k else wanted.join(g, [*k, "group"], "left")
    few = F.coalesce("rows", F.lit(0)) < min_n
    n = F.when(few, F.coalesce("rows", F.lit(0))).otherwise(F.col("pairs"))
    r = F.when(~few & (F.col("pairs") >= 4), F.col("r"))
    return j.select(*k, "group", n.alias("n"), r.alias("r"), fisher_z(r).alias("z"), F.when(~few & (n > 3), 1 / F.sqrt(n - 3)).alias("se_z"), few.alias("below_min_n"))


def contrast_vs_reference(per_group: DataFrame, reference: str = REFERENCE, alpha: float = 0.05) -> DataFrame:
    """Each group's z against the reference group's, with interval, standard error and detectable difference."""
    ref = per_group.filter(F.col("group") == reference).select(F.col("z").alias("zr"), F.col("n").alias("n_reference"), F.lit(1).alias("_one"))
    j = per_group.filter((F.col("group") != reference) & F.col("z").isNotNull()).join(F.broadcast(ref), F.lit(1) == F.col("_one"))  # one row
    ok = F.col("zr").isNotNull() & (F.col("n") > 3) & (F.col("n_reference") > 3)
    d = F.col("z") - F.col("zr")
    se = F.sqrt(1 / (F.col("n") - 3) + 1 / (F.col("n_reference") - 3))
    half = z_of(1 - alpha / 2) * se
    mde = min_detectable_delta_z(F.col("n"), F.col("n_reference"), alpha)
    return j.filter(ok).select("group", F.col("n").alias("n_group"), "n_reference", d.alias("delta_z"), (d - half).alias("delta_lo"), (d + half).alias("delta_hi"), se.alias("se"), mde.alias("mde_80pct"), (F.abs(d) >= mde).alias("detectable"))


def stratified_parts(frame: DataFrame, reference: str = REFERENCE, groups: Sequence[str] = GROUPS, min_n: int = MIN_CELL, keys: Sequence[str] = ()) -> DataFrame:
    """``group, stratum, d, w, n_g, n_r, used`` for each stratum and compared group: difference and weight."""
    k = list(keys)
    cells = frame.filter(F.col("stratum").isNotNull()).groupBy(*k, "stratum", "group").agg(F.count("*").alias("rows"), n_pairs(F.col("y_true"), F.col("y_pred")).alias("n"), pearson(F.col("y_true"), F.col("y_pred")).alias("r"))
    r = F.when(F.col("n") >= 4, F.col("r"))
    cells = cells.withColumn("z", fisher_z(r))
    others = [g for g in groups if g != reference]
    strata = frame.filter(F.col("stratum").isNotNull()).select(*k, "stratum").distinct().select("*", F.explode(F.array(*(F.lit(g) for g in others))).alias("group"))
    ref = cells.filter(F.col("group") == reference).select(*k, "stratum", F.col("z").alias("zr"), F.col("n").alias("n_r"), F.col("rows").alias("rr"))
    j = strata.join(cells.select(*k, "stratum", "group", F.col("z").alias("zg"), F.col("n").alias("n_g"), F.col("rows").alias("rg")), [*k, "stratum", "group"], "left").join(ref, [*k, "stratum"], "left")
    used = F.coalesce((F.col("rg") >= min_n) & (F.col("rr") >= min_n) & F.col("zg").isNotNull() & F.col("zr").isNotNull() & (F.col("n_g") > 3) & (F.col("n_r") > 3), F.lit(False))
    return j.select(*k, "group", "stratum", F.when(used, F.col("zg") - F.col("zr")).alias("d"), F.when(used, F.try_divide(F.lit(1.0), 1 / (F.col("n_g") - 3) + 1 / (F.col("n_r") - 3))).alias("w"), "n_g", "n_r", used.alias("used"))


def stratified_contrast(frame: DataFrame, reference: str = REFERENCE, groups: Sequence[str] = GROUPS, min_n: int = MIN_CELL, alpha: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Within-stratum differences of z to the reference, pooled by inverse variance, with Q, df and I2.

    frame: ``stratum, group, y_true, y_pred``. Strata with a cell below min_n are dropped and counted.
    """
    k = list(keys)
    p = stratified_parts(frame, reference, groups, min_n, keys)
    d, w = F.col("d"), F.col("w")
    g = p.groupBy(*k, "group").agg(
        F.sum(w).alias("sw"), F.sum(w * d).alias("swd"), F.sum(w * d * d).alias("swdd"), F.sum(F.when(F.col("used"), F.col("n_g"))).alias("n_group"), F.sum(F.when(F.col("used"), F.col("n_r"))).alias("n_reference"),
        F.count_if("used").alias("n_strata_used"), F.count_if(~F.col("used")).alias("n_strata_dropped"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("used"), F.col("stratum").cast("string")))), ", ").alias("strata"),
    )
    pooled, se = F.try_divide("swd", "sw"), F.sqrt(F.try_divide(F.lit(1.0), F.col("sw")))
    q = F.when(F.col("n_strata_used") > 0, F.greatest(F.col("swdd") - F.try_divide(F.col("swd") * F.col("swd"), F.col("sw")), F.lit(0.0)))
    df = F.when(F.col("n_strata_used") > 0, F.col("n_strata_used") - 1)
    i2 = F.when((q > 0) & (df > 0), F.greatest(F.lit(0.0), (q - df) / q) * 100).when(df.isNotNull(), 0.0)
    half = z_of(1 - alpha / 2) * se
    return g.select(*k, "group", pooled.alias("delta_z"), (pooled - half).alias("delta_lo"), (pooled + half).alias("delta_hi"), se.alias("se"), "n_group", "n_reference", "n_strata_used", "n_strata_dropped", "strata", q.alias("Q"), df.alias("df"), i2.alias("I2_pct"), ((z_of(1 - alpha / 2) + z_of(0.8)) * se).alias("mde_80pct"))


def with_heterogeneity(contrasts: DataFrame) -> DataFrame:
    """contrasts with ``heterogeneous``: Q beyond the 10 % point of its chi-square."""

    @F.pandas_udf("boolean")
    def beyond(q: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([bool(d and d > 0 and chi2_sf(x, d) < 0.10) if pd.notna(x) and pd.notna(d) else False for x, d in zip(q, df, strict=True)])

    return contrasts.withColumn("heterogeneous", beyond("Q", "df"))


def pooled_over_signatures(values: Sequence[float], n_boot: int = 2000, seed: int = 0, alpha: float = 0.05) -> tuple[float, float, float]:
    """Mean over a few signatures with a bootstrap interval; no interval for fewer than two."""
    x = np.array([v for v in values if v is not None and np.isfinite(v)])
    if len(x) < 2:
        return (float(x.mean()) if len(x) else np.nan), np.nan, np.nan
    draws = x[np.random.default_rng(seed).integers(0, len(x), (n_boot, len(x)))].mean(1)
    return float(x.mean()), *(float(v) for v in np.quantile(draws, [alpha / 2, 1 - alpha / 2]))


def site_identifiability(frame: DataFrame, reference: str = REFERENCE, groups: Sequence[str] = GROUPS, min_each: int = 10, group: str = "group", site: str = "site", stratum: str | None = None) -> DataFrame:
    """``group, n_group_total, n_sites_total, n_sites_supporting, frac_sites, n_in_supporting`` (and the same of
    stratum x site cells): places with min_each patients of both a group and the reference."""

    def support(*by: str) -> DataFrame:
        cells = frame.groupBy(*by, group).agg(F.count("*").alias("n"))
        ref = cells.filter(F.col(group) == reference).select(*by, F.col("n").alias("nr"))
        j = cells.filter(F.col(group).isin(*[g for g in groups if g != reference])).join(ref, list(by), "left")
        ok = F.coalesce((F.col("n") >= min_each) & (F.col("nr") >= min_each), F.lit(False))
        return j.groupBy(group).agg(F.sum("n").alias("total"), F.count_if(ok).alias("places"), F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("inside"))

    s = support(site).select(F.col(group).alias("group"), F.col("total").alias("n_group_total"), F.col("places").alias("n_sites_supporting"), F.col("inside").alias("n_in_supporting"))
    all_sites = frame.agg(F.countDistinct(site).alias("n_sites_total"), F.lit(1).alias("_one"))
    s = s.join(F.broadcast(all_sites), F.lit(1) == F.col("_one")).drop("_one")  # one row
    s = s.withColumn("frac_sites", F.col("n_sites_supporting") / F.col("n_sites_total"))
    if stratum:
        c = support(stratum, site).select(F.col(group).alias("group"), F.col("places").alias("n_cells_supporting"), F.col("inside").alias("n_in_cells"))
        s = s.join(c, "group", "left")
    return s


def composition(frame: DataFrame, group: str, label: str, reference: str = REFERENCE) -> DataFrame:
    """``group, label, n, share, enrichment``: a label's share of each group, and relative to the reference's."""
    n = frame.groupBy(group, label).agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))
    ref = share.filter(F.col(group) == reference).select(label, F.col("share").alias("_r"))
    return share.join(ref, label, "left").select(group, label, "n", "share", F.try_divide("share", "_r").alias("enrichment"))


def composition_report(frame: DataFrame, group: str, label: str, site: str, groups: Sequence[str] = GROUPS, reference: str = REFERENCE) -> dict[str, DataFrame]:
    """What tells whether a contrast of groups is confounded, over the named groups alone: ``counts`` (group, n, n_total), ``association``
    (label, the columns of :func:`cramers_v`: group against site and against label), ``shares`` (:func:`composition`)."""
    own = frame.filter(F.col(group).isin(list(groups)))
    counts = own.groupBy(group).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))  # one row
    both = [cramers_v(own, group, c).select(F.lit(c).alias("label"), "*") for c in (site, label)]
    return {"counts": counts.join(F.broadcast(total)), "association": both[0].unionByName(both[1]), "shares": composition(own, group, label, reference)}


def rank_auc(label: Column, score_rank: Column) -> Column:
    """Aggregate: area under the curve from average ranks of scores and a 0/1 label."""
    pos = F.sum(label)
    return F.try_divide(F.sum(F.when(label == 1, score_rank)) - pos * (pos + 1) / 2, pos * (F.count("*") - pos))
