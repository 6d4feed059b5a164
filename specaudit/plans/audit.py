"""The whole audit: does a predictor see something specific to named sets, beyond what any random set shares?"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import corr_interval, delta_r_interval, n_pairs, pearson
from ..operators import axis as axes
from ..operators import batch, inference, nulls, outcome, ridge, scoring, splits, variance
from ..operators.cohort import assert_unique
from ..sources import tables

OBSERVED = -1


@dataclass(frozen=True)
class AuditConfig:
    """Settings of a run; the defaults are those of the registered analysis."""

    n_folds: int = 5
    seed: int = 0
    split_seed: int | None = None
    n_boot: int = 1000
    alpha: float = 0.05
    n_null: int = 1000
    n_bins: int = 10
    scorer: str = "mean_z"
    axis_method: str = "pc1"
    axis_within_type: bool = True
    matched: bool = True
    disattenuate: bool = True
    ridge_alpha: float | None = None
    site_col: str = "tss"
    type_col: str = "cancer_type"
    purity_col: str | None = "purity"
    min_patients: int = 200
    with_combat: bool = False
    with_site_control: bool = True
    partition_repeats: int = 0
    with_raw_null: bool = False
    max_null_for_boot: int = inference.MAX_NULLS

    @property
    def fold_seed(self) -> int:
        return self.seed if self.split_seed is None else self.split_seed

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)


@dataclass
class AuditResult:
    """Named tables of a run, its primary estimate, notes, and the cohort's fingerprint."""

    config: AuditConfig
    tables: dict[str, DataFrame]
    primary: dict[str, float]
    fingerprint: str
    notes: list[str] = field(default_factory=list)

    def check_estimand(self) -> None:
        """The primary value must be the mean of the per-signature excesses, and n their number."""
        own = self.tables["immune_excess"].agg(F.avg("excess_z").alias("mean"), F.count("excess_z").alias("n")).first()
        if own["mean"] is None or abs(own["mean"] - self.primary["value"]) > 1e-9 or own["n"] != self.primary["n"]:
            raise AssertionError(f"primary {self.primary} isn't the mean of {own['n']} excesses, {own['mean']}")

    def save(self, folder: str, kind: str = "parquet") -> None:
        self.check_estimand()
        tables.save(self.tables, folder, kind)

    def headline(self) -> str:
        p = self.primary
        return f"specific index {p['value']:.4f} [{p['lo']:.4f}, {p['hi']:.4f}] over {p['n']} sets and {p['n_rows']} patients"


def group_baseline(frame: DataFrame, target: str, group: str | None, fold: str = "fold", keys: Sequence[str] = ()) -> DataFrame:
    """frame with ``baseline``: the training mean of the row's group (of all rows for an unseen group), by keys.

    Training sums are totals minus the fold's own, by group, so no dummies and no fits.
    """
    k = list(keys)
    y = F.when(~F.isnan(target), F.col(target))
    by = [*k, *([group] if group else [])]
    cells = frame.groupBy(*by, fold).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))  # windows go over these, not over rows
    whole, every = Window.partitionBy(*by), Window.partitionBy(*k)
    s, n = F.sum("_s").over(whole) - F.coalesce("_s", F.lit(0.0)), F.sum("_n").over(whole) - F.col("_n")
    means = cells.select(*by, fold, F.when(n > 0, s / n).alias("_mean"))
    # of all rows: a small table with a row for each fold
    folds = cells.groupBy(*k, fold).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    rest = folds.select(*k, fold, F.try_divide(F.sum("_s").over(every) - F.coalesce("_s", F.lit(0.0)), F.sum("_n").over(every) - F.col("_n")).alias("_all"))
    cell = F.struct(*by, fold).alias("_cell")  # never null, so that rows without a group find theirs
    known = means.join(rest, [*k, fold], "left").select(cell, F.coalesce("_mean", "_all").alias("baseline"))
    return frame.select("*", cell).join(known, "_cell", "left").select(*frame.columns, "baseline")


def linear_baseline(frame: DataFrame, target: str, x: str, fold: str = "fold", keys: Sequence[str] = ()) -> DataFrame:
    """frame with ``baseline``: a line on one number, fitted on the other folds' sums, by keys."""
    k = list(keys)
    ok = F.col(target).isNotNull() & F.col(x).isNotNull()
    terms = {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(target), "sxx": F.col(x) * F.col(x), "sxy": F.col(x) * F.col(target)}
    folds = frame.groupBy(*k, fold).agg(*(F.sum(F.when(ok, v).otherwise(0.0)).alias(c) for c, v in terms.items()))
    every = Window.partitionBy(*k)
    t = folds.select(*k, fold, *((F.sum(c).over(every) - F.col(c)).alias(c) for c in terms))
    slope = F.coalesce(F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")), F.lit(0.0))
    fit = t.filter("n > 0").select(*k, fold, slope.alias("_b"), (F.col("sy") / F.col("n")).alias("_my"), (F.col("sx") / F.col("n")).alias("_mx"))
    return frame.join(fit, [*k, fold], "left").withColumn("baseline", F.col("_my") + F.col("_b") * (F.col(x) - F.col("_mx"))).drop("_b", "_my", "_mx")


def baselines(frame: DataFrame, target: str = "score", keys: Sequence[str] = ("set_name",), groups: dict[str, str] | None = None, numbers: dict[str, str] | None = None) -> DataFrame:
    """``keys, r_<name>``: out-of-fold correlation of the target with each baseline, all sets in one plan.

    groups and numbers name baselines and the label or number that they stand on; frame also has ``fold``.
    """
    out = None
    for name, column, fit in [*((n, c, group_baseline) for n, c in (groups or {}).items()), *((n, c, linear_baseline) for n, c in (numbers or {}).items())]:
        got = fit(frame, target, column, keys=keys).groupBy(*keys).agg(pearson(F.col(target), F.col("baseline")).alias(f"r_{name}"))
        out = got if out is None else out.join(got, list(keys), "full")
    return out


def wide_targets(scores: DataFrame, names: Sequence[str], key: str = "sample") -> DataFrame:
    """``key, y``: scores of the named sets in order, missing ones null."""
    place = scores.sparkSession.createDataFrame([(n, k) for k, n in enumerate(names)], "set_name string, pos int")
    listed = scores.join(F.broadcast(place), "set_name").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("_l"))  # a row for each name
    by_place = F.map_from_entries("_l")
    some = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.try_element_at(by_place, k))
    return listed.select(F.col(key).alias("key"), F.when(F.size("_l") == len(names), F.transform("_l", lambda e: e["score"])).otherwise(some).alias("y"))


def predict_sets(x: DataFrame, scores: DataFrame, folds: DataFrame, names: Sequence[str], n_folds: int, alpha=None) -> DataFrame:
    """Out-of-fold predictions of sets' scores. x: ``key, x``; folds: ``key, fold``."""
    frame = x.join(folds, "key").join(wide_targets(scores, names), "key")
    return ridge.cross_val_predict(frame.select("key", "fold", "x", "y"), names, n_folds, alpha)


def _parts():
    """Name and draw of a set called ``name|draw``; names may hold bars themselves."""
    last = F.element_at(F.split("set_name", "[|]"), -1)
    return F.left("set_name", F.length("set_name") - F.length(last) - 1).alias("set_name"), last.cast("int").alias("draw")


def refit_residuals(x: DataFrame, resid: DataFrame, folds: DataFrame, names: Sequence[str], config: AuditConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictors refitted on the residuals of each set and of its random sets: ``set_name, draw, r, n``; for the
    bootstrap ``key, sets``; and the persisted rows behind these, to be released after it.

    resid: ``sample, set_name, draw, score``, the observed set as draw OBSERVED. A set's penalties are chosen on its own
    residuals, fold by fold, and hold for its random sets too. Sets and draws are targets of one frame, so the number of sets
    makes no further plans: correlations of all draws come from sums, predictions are made of the draws that the bootstrap takes.
    """
    draws = [OBSERVED, *range(config.n_null)]
    order = [(s, k) for s in names for k in draws]
    named = resid.select("sample", F.concat_ws("|", "set_name", F.col("draw").cast("string")).alias("set_name"), "score")
    frame = x.join(folds, "key").join(wide_targets(named, [f"{s}|{k}" for s, k in order]), "key").select("key", "fold", "x", "y").persist()
    pick = lambda places: F.transform(F.array(*(F.lit(i) for i in places)), lambda i: F.get("y", i))
    if config.ridge_alpha is None:
        own = ridge.choose_all_penalties(frame.withColumn("y", pick(range(0, len(order), len(draws)))), config.n_folds, len(names))
        alpha = {(k, s * len(draws) + d): a for (k, s), a in own.items() for d in range(len(draws))}
    else:
        alpha = config.ridge_alpha
    got = ridge.out_of_fold_correlations(frame, config.n_folds, len(order), alpha)
    table = x.sparkSession.createDataFrame([(s, k, r, n) for (s, k), (r, n) in zip(order, got, strict=True)], "set_name string, draw int, r double, n long")
    used = 1 + min(config.n_null, config.max_null_for_boot)
    kept = [s * len(draws) + d for s in range(len(names)) for d in range(used)]
    given = {(k, i): alpha[k, t] for i, t in enumerate(kept) for k in range(config.n_folds) if (k, t) in alpha} if isinstance(alpha, dict) else alpha
    pred = ridge.cross_val_predict(frame.withColumn("y", pick(kept)), [str(i) for i in range(len(kept))], config.n_folds, given)
    one = pred.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("target").cast("int").alias("i"), "y_true", "y_pred"))).alias("l"))
    whole = F.transform("l", lambda e: F.array(e["y_true"], e["y_pred"]))
    sets = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda s: F.flatten(F.slice(whole, s * used + 1, used)))
    lone = F.array(F.array(F.lit(None).cast("double")))  # a patient without some value
    return table, one.select("key", F.when(F.size("l") == len(kept), sets).otherwise(lone).alias("sets")), frame


def run_audit(frame: DataFrame, expr: DataFrame, sets: DataFrame, config: AuditConfig | None = None, survival: DataFrame | None = None) -> AuditResult:
    """Run all parts over a cohort.

    frame: one row for each patient with ``patient_id, x array<double>`` and the columns that config names;
    expr: ``sample, gene, value`` with sample = patient; survival: ``sample, time, event`` (and the type column).
    """
    c = config or AuditConfig()
    notes: list[str] = []
    assert_unique(frame, ["patient_id"], "cohort")
    n = frame.count()
    if n < c.min_patients:
        raise ValueError(f"{n} patients; {c.min_patients} are needed")
    spark = frame.sparkSession
    names = [r[0] for r in sets.select("set_name").distinct().orderBy("set_name").collect()]
    x = frame.select(F.col("patient_id").alias("key"), "x")
    types = frame.select(F.col("patient_id").alias("sample"), F.col(c.type_col).alias("type"))
    # some ten plans read it, whatever it takes to make it
    expr = expr.join(types.select("sample"), "sample", "left_semi").persist()

    random = splits.random_patient_split(frame, "patient_id", c.n_folds, c.fold_seed)
    site = splits.preserved_site_split(frame, c.site_col, "patient_id", c.n_folds, seed=c.fold_seed)
    scores = scoring.score_sets(expr, sets, c.scorer).persist()
    axis = (axes.global_axis_pc1(expr, types.select("sample", F.col("type").alias("group")) if c.axis_within_type else None) if c.axis_method == "pc1" else axes.global_axis_mean_z(expr)).select("sample", "axis").join(types, "sample").persist()
    within = "type" if c.axis_within_type else None

    # each set under both schemes, with baselines
    predictions = None
    for split in (random, site):
        p = predict_sets(x, scores, split.folds, names, c.n_folds, c.ridge_alpha).withColumn("scheme", F.lit(split.scheme))
        predictions = p if predictions is None else predictions.unionByName(p)
    predictions = predictions.persist()
    r = predictions.groupBy("target", "scheme").agg(pearson(F.col("y_true"), F.col("y_pred")).alias("r"), n_pairs(F.col("y_true"), F.col("y_pred")).alias("n"))
    lo, hi = corr_interval(F.col("r"), F.col("n"), c.alpha)
    r = r.select("*", lo.alias("lo"), hi.alias("hi"))
    a = r.filter(F.col("scheme") == random.scheme).select(F.col("target").alias("signature"), "n", *(F.col(k).alias(f"{k}_random_patient") for k in ("r", "lo", "hi")))
    b = r.filter(F.col("scheme") == site.scheme).select(F.col("target").alias("signature"), F.col("n").alias("n_site"), *(F.col(k).alias(f"{k}_preserved_site") for k in ("r", "lo", "hi")))
    per_signature = a.join(b, "signature")
    delta, dlo, dhi = delta_r_interval(F.col("r_random_patient"), F.col("n"), F.col("r_preserved_site"), F.col("n_site"), c.alpha)
    per_signature = per_signature.select("*", delta.alias("delta_z"), dlo.alias("delta_lo"), dhi.alias("delta_hi"), (F.col("r_random_patient") - F.col("r_preserved_site")).alias("delta_r"))
    base = scores.join(frame.select(F.col("patient_id").alias("sample"), F.col(c.site_col).alias("_site"), F.col(c.type_col).alias("_type"), *([F.col(c.purity_col).cast("double").alias("_purity")] if c.purity_col else [])), "sample").join(random.folds.withColumnRenamed("key", "sample"), "sample")
    beside = baselines(base, groups={"site_only": "_site", "type_only": "_type"}, numbers={"purity_only": "_purity"} if c.purity_col else {})
    per_signature = per_signature.join(beside.withColumnRenamed("set_name", "signature"), "signature", "left")
    out = {"per_signature": per_signature, "predictions": predictions}

    # what a patient loses in absolute error where its site is unseen
    wide = predictions.select("key", "target", "scheme", F.abs(F.col("y_true") - F.col("y_pred")).alias("e")).groupBy("key", "target").agg(*(F.max(F.when(F.col("scheme") == k.scheme, -F.col("e"))).alias(v) for k, v in ((random, "a"), (site, "b"))))
    out["secondary"] = inference.paired_delta(wide, "a", "b", "key", c.n_boot, c.seed, c.alpha).select(F.lit("delta_mae").alias("name"), "*")
    if c.purity_col:
        out["decomposition"] = decomposition(frame, scores, predictions.filter(F.col("scheme") == site.scheme), names, c)
    if c.with_raw_null:
        out["raw_null"] = legacy_null(x, expr, sets, site.folds, c)

    # symmetric refits of residual scores, on folds that keep sites whole: observed and random sets through one plan
    pool = expr.groupBy("gene").agg(F.avg("value").alias("level"))
    bins = nulls.level_bins(pool, c.n_bins)
    family = nulls.random_sets(sets, bins, c.n_null, c.seed, c.matched)
    everything = sets.select("set_name", F.lit(OBSERVED).alias("draw"), "gene").unionByName(family.select("set_name", F.col("draw").cast("int").alias("draw"), "gene"))
    all_sets = everything.select(F.concat_ws("|", "set_name", F.col("draw").cast("string")).alias("set_name"), "gene").persist()
    # residuals read them twice: for the lines and for what these leave
    scored = scoring.score_sets(expr, all_sets, c.scorer).persist()
    resid = axes.residualise(scored, axis, within).select("sample", "set_name", F.col("residual").alias("score")).persist()
    parted = resid.select("sample", *_parts(), "score")
    table, boot, refitted = refit_residuals(x, parted, site.folds, names, c)
    if c.disattenuate:
        gene_var = axes.residual_item_variances(scoring.z_scores(expr).withColumnRenamed("z", "value"), axis, within)
        rel = scoring.alpha_from_item_variances(resid, all_sets, gene_var)
        rel = rel.select(*_parts(), F.col("alpha").alias("reliability"))
        table = table.join(rel, ["set_name", "draw"], "left")
    table = table.persist()
    first = predictions.filter(F.col("scheme") == site.scheme).select(F.col("key").alias("sample"), F.col("target").alias("set_name"), F.col("y_pred").alias("prediction"))
    three = axes.three_way(scores, axis, first, within)
    seen, null = table.filter(F.col("draw") == OBSERVED).drop("draw"), table.filter(F.col("draw") != OBSERVED)
    excess = nulls.excess_over_null(seen.drop("n").join(three.select("set_name", "n"), "set_name"), null, alpha=c.alpha)
    degenerate = nulls.null_degeneracy(null.select("set_name", F.col("r").alias("value"))).select("set_name", F.col("mean").alias("null_mean_r"), F.col("sd").alias("null_sd_r"), "degenerate")
    immune = seen.select("set_name", F.col("r").alias("r_residual_refit"), *([F.col("reliability").alias("alpha_observed")] if c.disattenuate else []), "n").join(excess, "set_name").join(degenerate, "set_name")
    if c.disattenuate:
        plain = nulls.excess_over_null(seen.drop("reliability"), null.drop("reliability"), alpha=c.alpha).select("set_name", F.col("excess_z").alias("excess_z_uncorrected"))
        gap = null.groupBy("set_name").agg(F.avg("reliability").alias("alpha_null_mean"))
        immune = immune.join(plain, "set_name").join(gap, "set_name").withColumn("reliability_gap", F.col("alpha_observed") - F.col("alpha_null_mean"))
    immune = immune.persist()
    point = {row["set_name"]: row["excess_z"] for row in immune.select("set_name", "excess_z").collect()}
    defined = [s for s in names if point.get(s) is not None]
    if not defined:
        raise RuntimeError("no signature has an excess; the primary estimate is undefined")
    if len(defined) < len(names):
        notes.append(f"{len(defined)} of {len(names)} signatures have an excess")
    out["immune_excess"] = immune
    out["rotation"] = nulls.rotation_null(null.select("set_name", "draw", "r"), seen.select("set_name", "r"))
    out["three_way"] = three.join(seen.select("set_name", F.col("r").alias("r_residual_refit")), "set_name", "left")
    out["null_draws"] = null
    used = min(c.n_null, c.max_null_for_boot)
    if used < c.n_null:
        notes.append(f"the interval uses {used} of {c.n_null} draws, the value all of them")
    reliable: dict[str, dict[int, float | None]] = {s: {} for s in defined}
    if c.disattenuate:
        for row in table.filter(F.col("draw") < used).select("set_name", "draw", "reliability").toLocalIterator():
            if row["set_name"] in reliable:
                reliable[row["set_name"]][row["draw"]] = row["reliability"]
    at = [names.index(s) for s in defined]
    kept = boot.select("key", F.when(F.size("sets") == len(names), F.array(*(F.get("sets", F.lit(k)) for k in at))).otherwise(F.col("sets")).alias("sets"))
    alphas = {s: (reliable[s].get(OBSERVED), [reliable[s].get(k) for k in range(used)]) if c.disattenuate else (None, []) for s in defined}
    primary = inference.pooled_bootstrap(kept, alphas, c.n_boot, c.seed, c.alpha, point)
    refitted.unpersist()
    if primary["n_dropped"]:
        notes.append(f"{primary['n_dropped']} patients lack a value in some set or draw and take no part in the interval")

    if c.with_site_control:
        control = frame.select(F.col("patient_id").alias("key"), F.col(c.site_col).alias("site"), "x").join(random.folds, "key")
        out["site_control"] = batch.site_prediction_control(control, c.n_folds)
        if c.with_combat:
            out["site_control_combat"] = batch.site_prediction_control_oof_combat(control, c.n_folds)
            held = splits.estimable_fraction(frame.select(F.col("patient_id").alias("key"), F.col(c.site_col).alias("batch")).join(site.folds, "key"), "batch").agg(F.sum("n_estimable"), F.sum("n")).first()
            notes.append(f"an AUROC after the correction says nothing of the confound; with folds that keep sites whole it can be estimated for {held[0]} of {held[1]} held-out patients")
    if c.partition_repeats:
        good, bad = splits.repeated_site_splits(frame, c.site_col, "patient_id", c.n_folds, c.partition_repeats, seed=c.fold_seed)
        parts = None
        for k, split in enumerate(good):
            p = predict_sets(x, scores, split.folds, names, c.n_folds, c.ridge_alpha).groupBy("target").agg(pearson(F.col("y_true"), F.col("y_pred")).alias("r")).withColumn("repeat", F.lit(k))
            parts = p if parts is None else parts.unionByName(p)
        out["partition_variance"] = splits.partition_variance(parts, "r", "target")
        notes += [f"seed {k} gave a degenerate partition" for k in bad]
    if survival is not None:
        named = scored.select("sample", *_parts(), "score")
        arm = outcome.outcome_arm(named.filter(F.col("draw") == OBSERVED).drop("draw"), named.filter(F.col("draw") != OBSERVED), survival, axis, within, "type" if "type" in survival.columns else None)
        out["outcome_arm"] = arm
    mark = tables.fingerprint(frame, "patient_id").first()["fingerprint"]
    return AuditResult(c, out, primary, mark, notes)


def decomposition(frame: DataFrame, scores: DataFrame, predictions: DataFrame, names: Sequence[str], c: AuditConfig) -> DataFrame:
    """By set, the R2 of purity, then type, then site, then the prediction, and the prediction's correlation net of purity."""
    at = wide_targets(scores, names).withColumnRenamed("y", "_s")
    pred = wide_targets(predictions.select(F.col("key").alias("sample"), F.col("target").alias("set_name"), F.col("y_pred").alias("score")), names).withColumnRenamed("y", "_p")
    covariates = frame.select(F.col("patient_id").alias("key"), F.col(c.purity_col).cast("double").alias("purity"), F.col(c.type_col).alias("type"), F.col(c.site_col).alias("site"))
    wide = covariates.join(at, "key").join(pred, "key", "left")
    wide = wide.select("purity", "type", "site", *(F.get(a, F.lit(i)).alias(f"{b}{i}") for i in range(len(names)) for a, b in (("_s", "s"), ("_p", "p")))).persist()
    try:
        rungs = [("M0", []), ("M1_purity", ["purity"]), ("M2_type", ["purity", "type"]), ("M3_site", ["purity", "type", "site"])]
        ladders = variance.decompose_all(wide, [(f"s{i}", f"p{i}") for i in range(len(names))], rungs, ["type", "site"])
        long = wide.select("purity", F.explode(F.array(*(F.struct(F.lit(f"s{i}").alias("signature"), F.col(f"s{i}").alias("score"), F.col(f"p{i}").alias("prediction")) for i in range(len(names))))).alias("e")).select("purity", "e.*")
        shares = variance.purity_share(long, "score", "prediction", "purity", ["signature"]).toPandas()  # a row for each set
    finally:
        wide.unpersist()
    both = ladders.merge(shares, on="signature", how="left")
    both["signature"] = [names[int(s[1:])] for s in both["signature"]]
    table = frame.sparkSession.createDataFrame(both)
    return table.select(*(F.when(~F.isnan(k), F.col(k)).alias(k) if kind == "double" else F.col(k) for k, kind in table.dtypes))


def legacy_null(x: DataFrame, expr: DataFrame, sets: DataFrame, folds: DataFrame, config: AuditConfig) -> DataFrame:
    """The older raw contrast: correlations of predictions with scores of sets and of random sets, without an axis.

    Its standard error takes the number of draws for n, as the older tables do.
    """
    names = [r[0] for r in sets.select("set_name").distinct().orderBy("set_name").collect()]
    bins = nulls.level_bins(expr.groupBy("gene").agg(F.avg("value").alias("level")), config.n_bins)
    family = nulls.random_sets(sets, bins, config.n_null, config.seed, config.matched)
    drawn = family.select(F.concat_ws("|", "set_name", F.col("draw").cast("string")).alias("set_name"), "gene")
    scores = scoring.score_sets(expr, sets.select("set_name", "gene").unionByName(drawn), config.scorer).persist()
    targets = [*names, *(f"{s}|{k}" for s in names for k in range(config.n_null))]
    pred = predict_sets(x, scores, folds, targets, config.n_folds, config.ridge_alpha)
    r = pred.groupBy("target").agg(pearson(F.col("y_true"), F.col("y_pred")).alias("r"), F.count("*").alias("n")).persist()
    seen = r.filter(F.col("target").isin(names)).select(F.col("target").alias("set_name"), "r", "n")
    null = r.filter(~F.col("target").isin(names)).select(F.regexp_extract("target", r"^(.*)\|[0-9]+$", 1).alias("set_name"), "r")
    return nulls.null_summary(seen, null)


def run_variants(frame: DataFrame, expr: DataFrame, sets: DataFrame, base: AuditConfig, changes: dict[str, dict]) -> dict[str, AuditResult]:
    """One run for each named change of one or a few settings."""
    from dataclasses import replace

    return {name: run_audit(frame, expr, sets, replace(base, **change)) for name, change in changes.items()}


def covariate_baseline(frame: DataFrame, target: str, terms: Sequence[str], categorical: Sequence[str], n_folds: int) -> float:
    """Out-of-fold R2 of all covariates together (site, type, purity, stage): what a prediction has to add to."""
    from ..operators.variance import out_of_fold_r2

    return out_of_fold_r2(frame, target, terms, categorical, n_folds=n_folds)
