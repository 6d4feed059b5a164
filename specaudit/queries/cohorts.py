"""Queries over cohort tables: barcodes, joins, splits, groups, outcomes, variance, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import with_average_rank
from ..functions.stats import corr_interval, delta_r_interval, hash_order, min_detectable_delta_z, n_pairs, pearson
from ..operators import batch, groups, inference, nulls, outcome, ridge, splits, triage, variance
from ..operators import cohort as coh
from ..plans import sweep
from ..sources import barcodes, tables
from . import fixtures as fx
from .sqlmath import permuted

#: The code of a customer, as SQL of either engine.
_CODE = "CASE WHEN c_custkey % 17 = 0 THEN 'bad' || c_custkey ELSE ' tcga-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') || CASE c_custkey % 4 WHEN 0 THEN '-01A-11R-A1B2-07' WHEN 1 THEN '-11B' WHEN 2 THEN '' ELSE '-01' END END"


#: Participants from 'A000' to 'ZZZZ' hold the keys that four digits don't; each further round has sites of its own from 'A0'.
_SITE, _PARTICIPANT = "lpad(CAST(c_nationkey AS VARCHAR), 2, '0')", "lpad(CAST(c_custkey AS VARCHAR), 4, '0')"
_ROUND = "((c_custkey - 10000) DIV 1213056)"
_ANY_SITE = f"CASE WHEN c_custkey < 10000 OR {_ROUND} = 0 THEN {_SITE} WHEN {_ROUND} <= 37 THEN conv(335 + 25 * {_ROUND} + c_nationkey, 10, 36) ELSE raise_error('no code is left for customer ' || c_custkey) END"
_ANY_PARTICIPANT = f"CASE WHEN c_custkey < 10000 THEN {_PARTICIPANT} ELSE conv(466560 + (c_custkey - 10000) % 1213056, 10, 36) END"


def _coded(spark: SparkSession, d: str) -> DataFrame:
    code = _CODE.replace(_SITE, _ANY_SITE).replace(_PARTICIPANT, _ANY_PARTICIPANT).replace("VARCHAR", "STRING")
    return fx.table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment", code + " AS barcode")


def barcode_annotate(spark: SparkSession, d: str) -> DataFrame:
    return barcodes.annotate(_coded(spark, d)).drop("barcode", "c_mktsegment")


def site_summary(spark: SparkSession, d: str) -> DataFrame:
    return barcodes.site_summary(barcodes.annotate(_coded(spark, d))).select("tss", "n_patients", F.round("frac", 6).alias("frac"), F.round("cum_frac", 6).alias("cum_frac"))


def sample_mix(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    mix = coh.sample_mix(o, "o_custkey", "o_orderstatus", "F")
    return mix.select("o_custkey", F.array_join("codes", ",").alias("codes"), "several", "no_tumour")


def collapse_to_patient(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), "o_orderkey", "o_orderpriority", F.array(F.col("o_totalprice"), F.col("o_orderkey").cast("double")).alias("vector"))
    c = coh.collapse_to_patient(o, "o_orderkey")
    return c.select("patient_id", "o_orderkey", "o_orderpriority", "n_slides", F.round(F.get("vector", F.lit(0)), 6).alias("v0"), F.round(F.get("vector", F.lit(1)), 6).alias("v1"))


def assemble_cohort(spark: SparkSession, d: str) -> DataFrame:
    base = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("type"))
    o = fx.table(spark, d, "orders")
    clinical = o.groupBy(F.col("o_custkey").alias("patient_id")).agg(F.max("o_totalprice").alias("worst"))
    other = o.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("patient_id")).agg(F.count("*").alias("type"))
    return coh.assemble_cohort(base, {"clinical": clinical, "pending": other})


def join_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coh.coverage(assemble_cohort(spark, d), {"clinical": ["worst"], "pending": ["type_pending"]}).select("table_name", F.round("coverage", 6).alias("coverage"))


def cohort_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    return coh.overlap(o.filter("o_orderstatus = 'P'").select("o_custkey"), o.filter("o_orderpriority = '1-URGENT'").select("o_custkey"), "o_custkey")


def frame_difference(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    q = p.filter("p_partkey % 5 <> 0").withColumn("p_retailprice", F.col("p_retailprice") + F.col("p_partkey") % 3)
    return coh.frame_difference(p, q, "p_partkey")


def mean_by_patient(spark: SparkSession, d: str) -> DataFrame:
    m = coh.mean_by_patient(fx.expr(spark, d), F.floor(F.col("sample") / 2))
    return m.select("sample", "gene", F.round("value", 6).alias("value"))


def first_sample_by_patient(spark: SparkSession, d: str) -> DataFrame:
    return coh.first_sample_by_patient(fx.expr(spark, d), F.floor(F.col("sample") / 2)).select("sample", "gene", F.round("value", 6).alias("value"))


def ancestry_keep_first(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("Patient"), F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 7 == 1, "eas").when(F.col("event_id") % 7 == 2, "EUR").otherwise(F.col("event_type")).alias("ancestry"), "event_id")
    return tables.load_ancestry(e, ["event_id"], patient="Patient", ancestry="ancestry")


def purity_by_patient(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "orders").select(F.concat(F.lit("p-"), F.col("o_custkey").cast("string")).alias("sample"), F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("purity"))
    return tables.load_purity(p)[0].select("patient_id", F.round("purity", 6).alias("purity"))


def cohort_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return tables.fingerprint(fx.table(spark, d, "customer"), "c_custkey")


def random_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_patient_split(fx.cohort(spark, d), "patient").folds


def fold_balance(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cohort(spark, d)
    s = splits.random_patient_split(c, "patient", stratify="type")
    b = splits.fold_balance(c.join(s.folds, c["patient"] == s.folds["key"]), outcome="purity")
    return b.select("fold", "n", F.round("outcome_mean", 6).alias("outcome_mean"), F.round("outcome_sd", 6).alias("outcome_sd"))


def group_kfold_unit(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_kfold(fx.table(spark, d, "customer"), "c_custkey")


def preserved_site_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.preserved_site_split(fx.cohort(spark, d), "site", "patient", outcome="purity").folds


def partition_variance(spark: SparkSession, d: str) -> DataFrame:
    v = splits.partition_variance(fx.table(spark, d, "events"), "value", "event_type")
    return v.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "max")))


def combat_estimable(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cohort(spark, d)
    return splits.estimable_fraction(c.withColumn("fold", F.col("site") % 5), "type")


def fold_change_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = fx.table(spark, d, "customer")
    a = n.select(F.col("c_custkey").alias("site"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("version")).withColumn("fold", F.pmod(F.col("site") + F.when(F.col("site") % 10 < F.col("version"), 1).otherwise(0), F.lit(5)))
    return splits.fold_change_pairs(a).select("a", "b", "n", "n_changed", F.round("rand_index", 6).alias("rand_index"))


def sweep_merge(spark: SparkSession, d: str) -> DataFrame:
    li = fx.table(spark, d, "lineitem")
    shards = li.groupBy(F.col("l_suppkey").alias("split_seed")).agg(F.round(F.avg("l_discount"), 9).alias("isi")).select("split_seed", "isi", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("source")).filter("source = 'a' OR split_seed % 2 = 0")
    merged, missing = sweep.merge_shards(shards, ["isi"], fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("split_seed")).unionAll(spark.range(-3, 0).select(F.col("id").alias("split_seed"))))
    return merged.select("split_seed", F.round("isi", 6).alias("isi"), "source").unionByName(missing.select("split_seed", F.lit(None).cast("double").alias("isi"), F.lit("missing").alias("source")))


def corr_ci_pearson(spark: SparkSession, d: str) -> DataFrame:
    p = fx.predicted(spark, d).groupBy("stratum").agg(pearson(F.col("y_true"), F.col("y_pred")).alias("r"), n_pairs(F.col("y_true"), F.col("y_pred")).alias("n"))
    lo, hi = corr_interval(F.col("r"), F.col("n"))
    return p.select("stratum", F.round("r", 6).alias("r"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), "n")


def corr_ci_spearman(spark: SparkSession, d: str) -> DataFrame:
    p = fx.predicted(spark, d).select("stratum", "y_true", "y_pred")
    p = with_average_rank(with_average_rank(p, "y_true", "x", ["stratum"]), "y_pred", "y", ["stratum"])
    g = p.groupBy("stratum").agg(pearson(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n"))
    lo, hi = corr_interval(F.col("r"), F.col("n"))
    return g.select("stratum", F.round("r", 6).alias("r"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), "n")


def delta_r(spark: SparkSession, d: str) -> DataFrame:
    p = fx.predicted(spark, d).groupBy("stratum").agg(pearson(F.col("y_true"), F.col("y_pred")).alias("r1"), pearson(F.col("y_true"), F.col("other")).alias("r2"), F.count("*").alias("n"))
    x, lo, hi = delta_r_interval(F.col("r1"), F.col("n"), F.col("r2"), F.col("n"))
    return p.select("stratum", F.round(x, 6).alias("delta"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), F.round(min_detectable_delta_z(F.col("n"), F.col("n")), 6).alias("mde"))


def paired_delta_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    p = inference.paired_delta(fx.predicted(spark, d), "y_pred", "other", "cluster", n_boot=200)
    return p.select(*(F.round(c, 5).alias(c) for c in ("value", "lo", "hi")), "n")


def bootstrap_corr(spark: SparkSession, d: str) -> DataFrame:
    p = inference.bootstrap_corr(fx.predicted(spark, d), "y_true", "y_pred", "cluster", n_boot=200)
    return p.select(*(F.round(c, 5).alias(c) for c in ("value", "lo", "hi")), "n")


def bootstrap_corr_spearman(spark: SparkSession, d: str) -> DataFrame:
    p = inference.bootstrap_corr(fx.cohort(spark, d).withColumn("k", F.col("patient") % 97), "k", "purity", "site", n_boot=50, method="spearman")
    return p.select(*(F.round(c, 5).alias(c) for c in ("value", "lo", "hi")), "n")


def bh_fdr(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "part").select(F.col("p_partkey").alias("set_name"), F.col("p_brand").alias("family"), F.when(F.col("p_partkey") % 11 != 0, F.pow(F.col("p_partkey") * 7919 % 10007 / 10007.0, 3)).alias("p"))
    return nulls.bh_fdr(s, family="family").select("set_name", F.round("q", 9).alias("q"), "rejected")


def cramers_v(spark: SparkSession, d: str) -> DataFrame:
    v = groups.cramers_v(fx.predicted(spark, d), "group", "stratum")
    return v.select(*(F.round(c, 6).alias(c) for c in ("chi2", "phi2", "v", "v_corrected")), "n")


def cramers_v_perm(spark: SparkSession, d: str) -> DataFrame:
    v = groups.cramers_v_calibrated(fx.cohort(spark, d), "type", "group", "patient", n_perm=200)
    return v.select(*(F.round(c, 6).alias(c) for c in v.columns))


def group_correlations(spark: SparkSession, d: str) -> DataFrame:
    g = groups.group_correlations(fx.predicted(spark, d), (*fx.GROUPS, "NOWHERE"))
    return g.select("group", "n", *(F.round(c, 6).alias(c) for c in ("r", "z", "se_z")), "below_min_n")


def contrast_crude(spark: SparkSession, d: str) -> DataFrame:
    g = groups.contrast_vs_reference(groups.group_correlations(fx.predicted(spark, d), fx.GROUPS), fx.REFERENCE)
    return g.select("group", "n_group", "n_reference", *(F.round(c, 6).alias(c) for c in ("delta_z", "delta_lo", "delta_hi", "se", "mde_80pct")), "detectable")


def contrast_stratified(spark: SparkSession, d: str) -> DataFrame:
    g = groups.with_heterogeneity(groups.stratified_contrast(fx.predicted(spark, d), fx.REFERENCE, fx.GROUPS))
    return g.select("group", "heterogeneous", *(F.round(c, 6).alias(c) for c in ("delta_z", "delta_lo", "delta_hi", "mde_80pct", "se", "Q", "I2_pct")), "n_group", "n_reference", "n_strata_used", "n_strata_dropped", "strata", "df")


def site_identifiability(spark: SparkSession, d: str) -> DataFrame:
    c = fx.predicted(spark, d).withColumn("site", F.col("stratum")).withColumn("part", (F.col("y_pred") % 10).cast("int"))
    s = groups.site_identifiability(c, fx.REFERENCE, fx.GROUPS, stratum="part").na.fill(0, ["n_cells_supporting", "n_in_cells"])
    return s.select("group", "n_cells_supporting", "n_in_cells", "n_group_total", "n_sites_total", "n_sites_supporting", "n_in_supporting", F.round("frac_sites", 6).alias("frac_sites"))


def composition_share(spark: SparkSession, d: str) -> DataFrame:
    c = groups.composition(fx.cohort(spark, d), "group", "type", fx.REFERENCE)
    return c.select("group", "type", "n", F.round("share", 6).alias("share"), F.round("enrichment", 6).alias("enrichment"))


def composition_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the groups that take part, and their association with sites and with types."""
    r = groups.composition_report(fx.cohort(spark, d), "group", "type", "site", fx.GROUPS[:4], fx.REFERENCE)
    return r["counts"].join(r["association"].drop("n")).select("group", "n", "n_total", "label", *(F.round(c, 6).alias(c) for c in ("chi2", "phi2", "v", "v_corrected")))  # two rows


def concordance_index(spark: SparkSession, d: str) -> DataFrame:
    return outcome.concordance(fx.survival(spark, d)).select(F.round("c_index", 8).alias("c_index"), "n", "n_events")


def concordance_stratified(spark: SparkSession, d: str) -> DataFrame:
    return outcome.concordance(fx.survival(spark, d), strata="stratum").select(F.round("c_index", 8).alias("c_index"), "n", "n_events")


def type_rate_concordance(spark: SparkSession, d: str) -> DataFrame:
    return outcome.type_rate_concordance(fx.survival(spark, d).drop("score"), "stratum").select(F.round("c_index", 8).alias("c_index"), "n", "n_events")


def cox_score(spark: SparkSession, d: str) -> DataFrame:
    r = outcome.cox(fx.survival(spark, d))
    return spark.createDataFrame([tuple(round(r[k], 6) for k in ("hr", "coef", "se", "p", "c_index")) + (r["n"], r["n_events"])], "hr double, coef double, se double, p double, c_index double, n long, n_events long")


def outcome_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A price as the score, ten hash scores as its random sets, and survival."""
    s = fx.survival(spark, d)
    own = s.select("sample", F.lit("price").alias("set_name"), "score")
    null = s.select("sample", F.lit("price").alias("set_name"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("draw")).withColumn("score", F.conv(F.substring(hash_order(0, "draw", "sample"), 1, 8), 16, 10).cast("double"))
    return own, null, s.drop("score")


def outcome_arm(spark: SparkSession, d: str) -> DataFrame:
    own, null, s = outcome_scores(spark, d)
    axis = s.select("sample", (F.col("sample") % 1000).cast("double").alias("axis"))
    a = outcome.outcome_arm(own, null, s, axis, strata="stratum")
    return a.select("set_name", "adjustment", "n_events", "n_null", *(F.round(c, 6).alias(c) for c in ("observed", "excess_z", "lo", "hi", "mde_80pct_z")), "beats_null")


def predicted_folds(spark: SparkSession, d: str) -> DataFrame:
    """Prices and quantities as two targets, with folds by supplier."""
    p = fx.predicted(spark, d).withColumn("fold", F.col("cluster") % 5)
    return p.select("cluster", "stratum", "other", "fold", F.explode(F.create_map(F.lit("y_true"), F.col("y_true").cast("double"), F.lit("y_pred"), F.col("y_pred").cast("double"))).alias("set_name", "score"))


def auroc_by_site(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    x = e.select("vec_id", "label", F.col("embedding")[0].cast("double").alias("score")).join(e.select(F.col("label").alias("site")).distinct(), F.lit(True))
    return batch.auroc(x.withColumn("label", (F.col("label") == F.col("site")).cast("int"))).select("site", "n_patients", F.round("auroc", 8).alias("auroc"))


def _long(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.col("label").alias("batch"), F.posexplode("embedding")).select("key", "batch", F.col("pos").alias("dim"), F.col("col").cast("double").alias("value"), (F.col("key") % 5).alias("fold"))


def combat_apply(spark: SparkSession, d: str) -> DataFrame:
    return batch.combat(_long(spark, d)).select("key", "dim", F.round("corrected", 6).alias("corrected"), "estimable")


def combat_out_of_fold(spark: SparkSession, d: str) -> DataFrame:
    return batch.combat_out_of_fold(_long(spark, d), 5).select("key", "dim", F.round("corrected", 6).alias("corrected"), "estimable")


def r2_single_factor(spark: SparkSession, d: str) -> DataFrame:
    r = variance.single_factor_r2(fx.cohort(spark, d), "purity", "site")
    return r.select("n", "levels", F.round("r2", 8).alias("r2"), F.round("adj_r2", 8).alias("adj_r2"))


def permutation_calibration(spark: SparkSession, d: str) -> DataFrame:
    r = variance.permutation_calibration(fx.cohort(spark, d), "purity", "site", "patient", "type", n_perm=1000)
    return r.select(*(F.round(c, 8).alias(c) for c in r.columns))


def purity_share(spark: SparkSession, d: str) -> DataFrame:
    r = variance.purity_share(fx.predicted(spark, d), "y_true", "y_pred", "other", ["group"])
    return r.select("group", "n_share", *(F.round(c, 6).alias(c) for c in ("r_image", "r_purity", "r_partial")))


def _six(spark: SparkSession, table) -> DataFrame:
    """A small table with its numbers to six places, NaN as null."""
    out = spark.createDataFrame(table)
    return out.select(*(F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


def r2_ladder(spark: SparkSession, d: str) -> DataFrame:
    f = fx.cohort(spark, d).withColumn("score", F.col("purity") + F.col("site") * 10).withColumn("pred", F.col("patient") % 101 + F.col("site").cast("double"))
    rungs = [("M0", []), ("M1_purity", ["purity"]), ("M2_type", ["purity", "type"]), ("M3_site", ["purity", "type", "site"])]
    return _six(spark, variance.r2_ladder(f, "score", "pred", rungs, ["type", "site"]))


def label_site_variance(spark: SparkSession, d: str) -> DataFrame:
    return _six(spark, variance.label_site_variance(fx.cohort(spark, d), ["purity"], "site", "type"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("key"), (F.col("vec_id") % 5).cast("int").alias("fold"), F.slice(v, 1, 48).alias("x"), F.slice(v, 49, 16).alias("y"), F.col("label").alias("site"))


def ridge_oof(spark: SparkSession, d: str) -> DataFrame:
    r = ridge.cross_val_predict(_blocks(spark, d), [f"g{k}" for k in range(48, 64)], 5, alpha=10.0)
    return r.select("key", "fold", "target", F.round("y_true", 6).alias("y_true"), F.round("y_pred", 6).alias("y_pred"))


def ridge_loo_alpha(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    b = _blocks(spark, d)
    centre = np.zeros(48)
    chosen = ridge.select_alphas(b, ridge.moments(b, centre), centre, range(5))
    return spark.createDataFrame([(k, round(a, 8)) for k, a in sorted(chosen.items())], "fold long, alpha double")


def impute_medians(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).withColumn("x", F.transform("x", lambda v, i: F.when((F.col("key") + i) % 7 != 0, v)))
    return ridge.impute_medians(b).select("pos", F.round("median", 6).alias("median"))


def site_logistic(spark: SparkSession, d: str) -> DataFrame:
    return batch.site_prediction_control(_blocks(spark, d)).select("site", "n_patients", F.round("auroc", 6).alias("auroc"))


def site_logistic_pair(spark: SparkSession, d: str) -> DataFrame:
    """The same on the first two dimensions alone, whose Newton steps SQL can take too."""
    b = _blocks(spark, d).withColumn("x", F.slice("x", 1, 2))
    return batch.site_prediction_control(b).select("site", "n_patients", F.round("auroc", 6).alias("auroc"))


def site_logistic_combat(spark: SparkSession, d: str) -> DataFrame:
    """After a correction of each fold by the others' moments, which leaves little of a site to be seen."""
    r = batch.site_prediction_control_oof_combat(_blocks(spark, d))
    return r.select("site", "n_patients", F.round("auroc", 6).alias("auroc"), "estimable")


def effective_tests(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scoring import score_mean_z

    names, m = inference.correlation_matrix(score_mean_z(fx.expr(spark, d), fx.sets(spark)))
    return spark.createDataFrame([(len(names), round(inference.effective_tests(m), 6))], "n_sets int, m_eff double")


def pooled_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.array(*(F.array(*(x for k in range(6) for x in (F.get(v, F.lit(48 + 4 * s + k % 4)), F.get(v, F.lit(6 * s + k))))) for s in range(3))).alias("sets"))
    r = inference.pooled_bootstrap(e, {f"s{s}": (0.8, [0.7] * 5) for s in range(3)}, n_boot=100)
    return spark.createDataFrame([(r["value"], r["lo"], r["hi"], r["n"], r["n_draws"])], "value double, lo double, hi double, n long, n_draws long")


def attrition_funnel(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders")
    return triage.attrition(o, [("finished", F.col("o_orderstatus") == "F"), ("large", F.col("o_totalprice") > 100000), ("urgent", F.col("o_orderpriority") == "1-URGENT")], "o_custkey")


def value_spread(spark: SparkSession, d: str) -> DataFrame:
    s = triage.spread(fx.table(spark, d, "events"), "value", "event_type")
    return s.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("median", "q1", "q3", "min", "max")))


def set_size_stats(spark: SparkSession, d: str) -> DataFrame:
    sets = fx.table(spark, d, "part").select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("gene"))
    return triage.set_size_stats(triage.filter_set_names(sets, ["Brand#1"]))


def nonspace_count(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "nation").select("n_nationkey", triage.nonspace_length(F.col("n_name")).alias("n_chars"))


def bh_directional(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("set_name"), ((F.col("p_partkey") * 7919 % 1009 - 500) / 100.0).alias("excess_z"))
    s = triage.significance(p.withColumn("lo", F.col("excess_z") - 1.0).withColumn("hi", F.col("excess_z") + 1.0))
    return s.select("set_name", F.round("z_stat", 6).alias("z_stat"), "beats_null_bh")


def imputed_features(spark: SparkSession, d: str) -> DataFrame:
    b = _blocks(spark, d).withColumn("x", F.transform("x", lambda v, i: F.when((F.col("key") + i) % 7 != 0, v)))
    return ridge.apply_medians(b, ridge.impute_medians(b)).select("key", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


def label_site_r2(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame(variance.label_site_variance(fx.cohort(spark, d), ["purity", "patient"], "site"))
    return t.select("signature", "n", "n_sites", F.round("r2_site_only", 8).alias("r2_site_only"), F.round("adj_r2_site_only", 8).alias("adj_r2_site_only"))


def ancestry_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Stratified differences of each group, pooled over two predictions."""
    p = fx.predicted(spark, d)
    both = [groups.stratified_contrast(p.withColumn("y_pred", F.col(c)), fx.REFERENCE, fx.GROUPS) for c in ("y_pred", "other")]
    rows = both[0].unionByName(both[1]).select("group", "delta_z").collect()
    out = [(g, *(round(v, 6) for v in groups.pooled_over_signatures([r["delta_z"] for r in rows if r["group"] == g]))) for g in sorted({r["group"] for r in rows})]
    return spark.createDataFrame(out, "group string, value double, lo double, hi double")


def event_moments(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.moments import windowed_moments

    m = windowed_moments(fx.table(spark, d, "events"), "ts", "value", ["event_type"], "1 day")
    return m.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_Z = 1.959963984540054
_Z80 = 0.8416212335729143
_RE = barcodes.PATTERN
def _chi(cells: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    by = f"PARTITION BY {k}"
    return f"""c AS (SELECT {k}x, y, count(*) AS c FROM {cells} GROUP BY ALL),
m AS (SELECT {k}x, y, c, sum(c) OVER ({by}x) AS rt, sum(c) OVER ({by}y) AS ct FROM c),
g AS (SELECT {k}sum(c) AS n, greatest(sum(c * c / (rt * ct)) - 1, 0) AS phi2, count(DISTINCT x) AS r, count(DISTINCT y) AS q FROM m {"GROUP BY " + keys if keys else ""})"""


_DIGIT = "substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({0} AS INTEGER) % 36 + 1, 1)"
_BASE36 = lambda x, digits: "(" + " || ".join(_DIGIT.format(f"(({x}) // {36**k})") for k in reversed(range(digits))) + ")"
_DUCK_ROUND = "((c_custkey - 10000) // 1213056)"
_DUCK_CODE = _CODE.replace(_SITE, f"CASE WHEN c_custkey < 10000 OR {_DUCK_ROUND} = 0 THEN {_SITE} ELSE {_BASE36(f'335 + 25 * {_DUCK_ROUND} + c_nationkey', 2)} END").replace(_PARTICIPANT, f"CASE WHEN c_custkey < 10000 THEN {_PARTICIPANT} ELSE {_BASE36('466560 + (c_custkey - 10000) % 1213056', 4)} END")

ORACLE_SQL = {
    "barcode_annotate": f"""WITH b AS (SELECT c_custkey, upper(trim({_DUCK_CODE})) AS b FROM customer), p AS (SELECT * FROM b WHERE regexp_matches(b, '{_RE}'))
SELECT c_custkey, 'TCGA-' || regexp_extract(b, '{_RE}', 1) || '-' || regexp_extract(b, '{_RE}', 2) AS patient_id, regexp_extract(b, '{_RE}', 1) AS tss, nullif(regexp_extract(b, '{_RE}', 3), '') AS sample_type, regexp_extract(b, '{_RE}', 3) = '01' AS is_primary_tumour, nullif(regexp_extract(b, '{_RE}', 7), '') AS plate FROM p""",
    "site_summary": f"""WITH b AS (SELECT upper(trim({_DUCK_CODE})) AS b FROM customer), s AS (SELECT regexp_extract(b, '{_RE}', 1) AS tss, count(DISTINCT substr(b, 1, 12)) AS n FROM b WHERE regexp_matches(b, '{_RE}') GROUP BY 1)
SELECT tss, n AS n_patients, round(n / sum(n) OVER (), 6) AS frac, round(sum(n) OVER (ORDER BY n DESC, tss ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_frac FROM s""",
    "sample_mix": "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS codes, count(DISTINCT o_orderstatus) > 1 AS several, count(*) FILTER (o_orderstatus = 'F') = 0 AS no_tumour FROM orders GROUP BY 1",
    "collapse_to_patient": "SELECT o_custkey AS patient_id, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, count(*) AS n_slides, round(avg(o_totalprice), 6) AS v0, round(avg(o_orderkey), 6) AS v1 FROM orders GROUP BY 1",
    "assemble_cohort": "SELECT c_custkey AS patient_id, c_mktsegment AS type, worst, t AS type_pending FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS worst, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS t FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "join_coverage": "WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1), j AS (SELECT o_custkey, p FROM customer LEFT JOIN o ON c_custkey = o_custkey) SELECT 'clinical' AS table_name, round(avg((o_custkey IS NOT NULL)::DOUBLE), 6) AS coverage FROM j UNION ALL SELECT 'pending', round(avg((coalesce(p, 0) > 0)::DOUBLE), 6) FROM j",
    "cohort_overlap": "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT (SELECT count(*) FROM a ANTI JOIN b USING (k)) AS n_left_only, (SELECT count(*) FROM b ANTI JOIN a USING (k)) AS n_right_only, (SELECT count(*) FROM a SEMI JOIN b USING (k)) AS n_both",
    "frame_difference": "SELECT 'p_brand' AS column_name, count(*) FILTER (p_partkey % 5 = 0) AS n_unequal, CAST(NULL AS DOUBLE) AS max_abs_diff FROM part UNION ALL SELECT 'p_retailprice', count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 3 <> 0), max(abs(p_retailprice - (p_retailprice + p_partkey % 3))) FILTER (p_partkey % 5 <> 0) FROM part",
    "mean_by_patient": f"WITH {fx.EXPR} SELECT sample // 2 AS sample, gene, round(avg(value), 6) AS value FROM expr GROUP BY ALL",
    "first_sample_by_patient": f"WITH {fx.EXPR}, f AS (SELECT min(sample) AS sample FROM expr GROUP BY sample // 2) SELECT sample // 2 AS sample, gene, round(value, 6) AS value FROM expr JOIN f USING (sample)",
    "ancestry_keep_first": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS p, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'eas' WHEN 2 THEN 'EUR' ELSE event_type END AS a, event_id FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY substr(upper(p), 1, 12) ORDER BY event_id) AS r FROM e)
SELECT substr(upper(p), 1, 12) AS patient_id, a AS ancestry_raw, CASE WHEN a IS NULL THEN 'UNKNOWN' WHEN upper(a) IN ('EAS', 'SAS', 'ASIAN') THEN 'ASIAN' WHEN upper(a) IN ('EUR', 'AFR', 'AMR') THEN upper(a) ELSE 'ADMIXED' END AS ancestry FROM f WHERE r = 1""",
    "purity_by_patient": "SELECT upper('p-' || o_custkey) AS patient_id, round(avg(o_totalprice), 6) AS purity FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1",
    "random_folds": f"WITH {fx.COHORT} SELECT patient AS key, CAST((row_number() OVER (ORDER BY md5('0|' || patient), patient) - 1) % 5 AS INTEGER) AS fold FROM cohort",
    "fold_balance": f"WITH {fx.COHORT}, f AS (SELECT purity, CAST((row_number() OVER (PARTITION BY type ORDER BY md5('0|' || patient), patient) - 1) % 5 AS INTEGER) AS fold FROM cohort) SELECT fold, count(*) AS n, round(avg(purity), 6) AS outcome_mean, round(stddev_samp(purity), 6) AS outcome_sd FROM f GROUP BY 1",
    "group_kfold_unit": "SELECT c_custkey, CAST((count(*) OVER () - row_number() OVER (ORDER BY c_custkey)) % 5 AS INTEGER) AS fold FROM customer",
    "partition_variance": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1",
    "combat_estimable": f"WITH {fx.COHORT}, c AS (SELECT type, site % 5 AS fold FROM cohort), s AS (SELECT type, count(DISTINCT fold) AS f FROM c GROUP BY 1) SELECT fold, count(*) AS n, count(*) FILTER (f > 1) AS n_estimable FROM c JOIN s USING (type) GROUP BY 1",
    "fold_change_pairs": """WITH a AS (SELECT c_custkey AS s, v, (c_custkey + (c_custkey % 10 < v)::INT) % 5 AS f FROM customer, range(0, 3) AS r(v)), j AS (SELECT l.v AS a, r.v AS b, l.f AS x, r.f AS y, count(*) AS c FROM a l JOIN a r USING (s) WHERE l.v < r.v GROUP BY ALL),
sx AS (SELECT a, b, sum(c * (c - 1) / 2) AS sx FROM (SELECT a, b, x, sum(c) AS c FROM j GROUP BY ALL) GROUP BY ALL), sy AS (SELECT a, b, sum(c * (c - 1) / 2) AS sy FROM (SELECT a, b, y, sum(c) AS c FROM j GROUP BY ALL) GROUP BY ALL),
g AS (SELECT a, b, sum(c) AS n, sum(c) FILTER (x <> y) AS ch, sum(c * (c - 1) / 2) AS s FROM j GROUP BY ALL)
SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(n AS BIGINT) AS n, CAST(coalesce(ch, 0) AS BIGINT) AS n_changed, round((s - sx * sy / (n * (n - 1) / 2)) / ((sx + sy) / 2 - sx * sy / (n * (n - 1) / 2)), 6) AS rand_index FROM g JOIN sx USING (a, b) JOIN sy USING (a, b)""",
    "sweep_merge": "WITH s AS (SELECT l_suppkey AS split_seed, round(round(avg(l_discount), 9), 6) AS isi FROM lineitem GROUP BY 1) SELECT split_seed, isi, 'a' AS source FROM s UNION ALL SELECT k, NULL, 'missing' FROM (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT * FROM range(-3, 0)) ANTI JOIN s ON k = split_seed",
    "corr_ci_pearson": f"WITH {fx.PREDICTED}, g AS (SELECT stratum, corr(y_true, y_pred) AS r, count(*) AS n FROM pred GROUP BY 1) SELECT stratum, round(r, 6) AS r, round(tanh(atanh(r) - {_Z} / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + {_Z} / sqrt(n - 3)), 6) AS hi, n FROM g",
    "corr_ci_spearman": f"WITH {fx.PREDICTED}, k AS (SELECT stratum, rank() OVER (PARTITION BY stratum ORDER BY y_true) + (count(*) OVER (PARTITION BY stratum, y_true) - 1) / 2.0 AS x, rank() OVER (PARTITION BY stratum ORDER BY y_pred) + (count(*) OVER (PARTITION BY stratum, y_pred) - 1) / 2.0 AS y FROM pred), g AS (SELECT stratum, corr(x, y) AS r, count(*) AS n FROM k GROUP BY 1) SELECT stratum, round(r, 6) AS r, round(tanh(atanh(r) - {_Z} / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + {_Z} / sqrt(n - 3)), 6) AS hi, n FROM g",
    "delta_r": f"WITH {fx.PREDICTED}, g AS (SELECT stratum, atanh(corr(y_true, y_pred)) - atanh(corr(y_true, other)) AS x, count(*) AS n FROM pred GROUP BY 1) SELECT stratum, round(x, 6) AS delta, round(x - {_Z} * sqrt(2 / (n - 3)), 6) AS lo, round(x + {_Z} * sqrt(2 / (n - 3)), 6) AS hi, round(({_Z} + {_Z80}) * sqrt(2 / (n - 3)), 6) AS mde FROM g",
    "paired_delta_bootstrap": f"""WITH {fx.PREDICTED}, s AS (SELECT cluster, count(*) AS n, sum(y_pred - other) AS d, row_number() OVER (ORDER BY cluster) - 1 AS p FROM pred GROUP BY cluster), g AS (SELECT count(*) AS g FROM s),
h AS (SELECT b, CAST('0x' || substr(md5('0|' || b || '|' || p), 1, 8) AS BIGINT) % g AS p FROM s, g, range(0, 200) AS r(b)), v AS (SELECT b, sum(d) / sum(n) AS v FROM h JOIN s USING (p) GROUP BY b)
SELECT round((SELECT sum(d) / sum(n) FROM s), 5) AS value, round(quantile_cont(v, 0.025), 5) AS lo, round(quantile_cont(v, 0.975), 5) AS hi, (SELECT g FROM g) AS n FROM v""",
    "bootstrap_corr": f"""WITH {fx.PREDICTED}, k AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS p FROM (SELECT DISTINCT cluster FROM pred)), g AS (SELECT count(*) AS g FROM k),
h AS (SELECT b, CAST('0x' || substr(md5('0|' || b || '|' || p), 1, 8) AS BIGINT) % g AS p FROM k, g, range(0, 200) AS r(b)), v AS (SELECT b, corr(y_true, y_pred) AS v FROM h JOIN k USING (p) JOIN pred USING (cluster) GROUP BY b)
SELECT round((SELECT corr(y_true, y_pred) FROM pred), 5) AS value, round(quantile_cont(v, 0.025), 5) AS lo, round(quantile_cont(v, 0.975), 5) AS hi, (SELECT g FROM g) AS n FROM v""",
    "bootstrap_corr_spearman": f"""WITH {fx.COHORT}, c AS (SELECT site, patient % 97 AS x, purity AS y FROM cohort), k AS (SELECT site, row_number() OVER (ORDER BY site) - 1 AS p FROM (SELECT DISTINCT site FROM c)), g AS (SELECT count(*) AS g FROM k),
h AS (SELECT b, CAST('0x' || substr(md5('0|' || b || '|' || p), 1, 8) AS BIGINT) % g AS p FROM k, g, range(0, 50) AS r(b)), e AS (SELECT b, x, y FROM h JOIN k USING (p) JOIN c USING (site) UNION ALL SELECT -1, x, y FROM c),
q AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2.0 AS y FROM e), v AS (SELECT b, corr(x, y) AS v FROM q GROUP BY b)
SELECT round(max(v) FILTER (b = -1), 5) AS value, round(quantile_cont(v, 0.025) FILTER (b >= 0), 5) AS lo, round(quantile_cont(v, 0.975) FILTER (b >= 0), 5) AS hi, (SELECT g FROM g) AS n FROM v""",
    "bh_fdr": """WITH s AS (SELECT p_partkey AS k, p_brand AS f, CASE WHEN p_partkey % 11 <> 0 THEN pow(p_partkey * 7919 % 10007 / 10007.0, 3) END AS p FROM part), r AS (SELECT *, p * count(p) OVER (PARTITION BY f) / row_number() OVER (PARTITION BY f ORDER BY p, k) AS q FROM s WHERE p IS NOT NULL),
q AS (SELECT k, least(1, min(q) OVER (PARTITION BY f ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r) SELECT s.k AS set_name, round(q, 9) AS q, coalesce(q <= 0.05, false) AS rejected FROM s LEFT JOIN q USING (k)""",
    "cramers_v": f"WITH {fx.PREDICTED}, xy AS (SELECT grp AS x, stratum AS y FROM pred), {_chi('xy')} SELECT round(phi2 * n, 6) AS chi2, round(phi2, 6) AS phi2, round(sqrt(phi2 / (least(r, q) - 1)), 6) AS v, round(sqrt(greatest(0, phi2 - (r - 1) * (q - 1) / (n - 1)) / (least(r - (r - 1) * (r - 1) / (n - 1), q - (q - 1) * (q - 1) / (n - 1)) - 1)), 6) AS v_corrected, CAST(n AS BIGINT) AS n FROM g",
    "cramers_v_perm": f"""WITH {fx.COHORT}, {permuted('cohort', 'patient', None, 200)},
xy AS (SELECT perm, c.type AS x, o.grp AS y FROM deal JOIN own o USING (p) JOIN cohort c ON c.patient = deal.k UNION ALL SELECT -1, type, grp FROM cohort), {_chi('xy', 'perm')}, v AS (SELECT perm, sqrt(phi2 / (least(r, q) - 1)) AS v FROM g), o AS (SELECT v AS o FROM v WHERE perm = -1)
SELECT round(max(o), 6) AS v, round(median(v), 6) AS null_median, round(quantile_cont(v, 0.95), 6) AS null_p95, round(max(o) - median(v), 6) AS v_calibrated, round((1 + count(*) FILTER (v >= o)) / (1.0 + count(*)), 6) AS perm_p FROM v, o WHERE perm >= 0""",
    "group_correlations": f"WITH {fx.PREDICTED}, g AS (SELECT grp, corr(y_true, y_pred) AS r, count(*) AS n FROM pred GROUP BY 1) SELECT w.grp AS group, coalesce(n, 0) AS n, round(r, 6) AS r, round(atanh(r), 6) AS z, round(1 / sqrt(n - 3), 6) AS se_z, coalesce(n, 0) < 20 AS below_min_n FROM (SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST', 'NOWHERE']) AS grp) w LEFT JOIN g USING (grp)",
    "contrast_crude": f"""WITH {fx.PREDICTED}, g AS (SELECT grp, atanh(corr(y_true, y_pred)) AS z, count(*) AS n FROM pred GROUP BY 1), c AS (SELECT a.grp, a.n, b.n AS m, a.z - b.z AS d, sqrt(1 / (a.n - 3) + 1 / (b.n - 3)) AS se FROM g a, g b WHERE b.grp = 'EUROPE' AND a.grp <> 'EUROPE')
SELECT grp AS group, n AS n_group, m AS n_reference, round(d, 6) AS delta_z, round(d - {_Z} * se, 6) AS delta_lo, round(d + {_Z} * se, 6) AS delta_hi, round(se, 6) AS se, round(({_Z} + {_Z80}) * se, 6) AS mde_80pct, abs(d) >= ({_Z} + {_Z80}) * se AS detectable FROM c""",
    "contrast_stratified": f"""WITH {fx.PREDICTED}, g AS (SELECT grp, stratum, atanh(corr(y_true, y_pred)) AS z, count(*) AS n FROM pred GROUP BY ALL HAVING count(*) >= 20),
s AS (SELECT grp, stratum FROM (SELECT DISTINCT stratum FROM pred), (SELECT unnest(['AFRICA', 'AMERICA', 'ASIA', 'MIDDLE EAST']) AS grp)),
j AS (SELECT s.grp, s.stratum, a.z - b.z AS d, 1 / (1 / (a.n - 3) + 1 / (b.n - 3)) AS w, a.n AS n, b.n AS m FROM s LEFT JOIN g a ON a.grp = s.grp AND a.stratum = s.stratum LEFT JOIN g b ON b.grp = 'EUROPE' AND b.stratum = s.stratum),
p AS (SELECT grp, sum(w * d) / sum(w) AS x, sum(w) AS sw, sum(n) FILTER (d IS NOT NULL) AS n, sum(m) FILTER (d IS NOT NULL) AS m, count(d) AS u, count(*) - count(d) AS dr, coalesce(string_agg(stratum, ', ' ORDER BY stratum) FILTER (d IS NOT NULL), '') AS st FROM j GROUP BY 1),
q AS (SELECT p.*, (SELECT sum(w * (d - x) * (d - x)) FROM j WHERE j.grp = p.grp) AS q FROM p)
SELECT grp AS group, coalesce(q > CASE u WHEN 2 THEN 2.705543454095404 WHEN 3 THEN 4.605170185988092 END, false) AS heterogeneous, round(x, 6) AS delta_z, round(x - {_Z} * sqrt(1 / sw), 6) AS delta_lo, round(x + {_Z} * sqrt(1 / sw), 6) AS delta_hi, round(({_Z} + {_Z80}) * sqrt(1 / sw), 6) AS mde_80pct, round(sqrt(1 / sw), 6) AS se, round(q, 6) AS "Q", round(CASE WHEN u = 0 THEN NULL WHEN q > 0 AND u > 1 THEN greatest(0, (q - (u - 1)) / q) * 100 ELSE 0 END, 6) AS "I2_pct", CAST(n AS BIGINT) AS n_group, CAST(m AS BIGINT) AS n_reference, u AS n_strata_used, dr AS n_strata_dropped, st AS strata, CASE WHEN u > 0 THEN u - 1 END AS df FROM q""",
    "site_identifiability": f"""WITH {fx.PREDICTED}, c AS (SELECT stratum AS site, grp, count(*) AS n FROM pred GROUP BY ALL), c2 AS (SELECT stratum AS site, CAST(y_pred % 10 AS INTEGER) AS part, grp, count(*) AS n FROM pred GROUP BY ALL),
j2 AS (SELECT a.grp, a.n, coalesce(a.n >= 10 AND b.n >= 10, false) AS ok FROM c2 a LEFT JOIN c2 b ON b.site = a.site AND b.part = a.part AND b.grp = 'EUROPE' WHERE a.grp <> 'EUROPE'), cells AS (SELECT grp, count(*) FILTER (ok) AS p, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS i FROM j2 GROUP BY 1), j AS (SELECT a.grp, a.n, coalesce(a.n >= 10 AND b.n >= 10, false) AS ok FROM c a LEFT JOIN c b ON b.site = a.site AND b.grp = 'EUROPE' WHERE a.grp <> 'EUROPE')
SELECT grp AS group, any_value(cells.p) AS n_cells_supporting, any_value(cells.i) AS n_in_cells, CAST(sum(n) AS BIGINT) AS n_group_total, (SELECT count(DISTINCT stratum) FROM pred) AS n_sites_total, count(*) FILTER (ok) AS n_sites_supporting, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS n_in_supporting, round(count(*) FILTER (ok) / (SELECT count(DISTINCT stratum) FROM pred), 6) AS frac_sites FROM j JOIN cells USING (grp) GROUP BY 1""",
    "composition_share": f"WITH {fx.COHORT}, t AS (SELECT grp, type, count(*) AS n FROM cohort GROUP BY ALL), s AS (SELECT grp, type, n, n / sum(n) OVER (PARTITION BY grp) AS s FROM t) SELECT a.grp AS group, a.type, a.n, round(a.s, 6) AS share, round(a.s / b.s, 6) AS enrichment FROM s a LEFT JOIN s b ON b.grp = 'EUROPE' AND a.type = b.type",
    "composition_report": f"""WITH {fx.COHORT}, own AS (SELECT * FROM cohort WHERE grp IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')), l AS (SELECT 'site' AS label, grp AS x, CAST(site AS VARCHAR) AS y FROM own UNION ALL SELECT 'type', grp, type FROM own), {_chi('l', 'label')}, b AS (SELECT *, greatest(0, phi2 - (r - 1) * (q - 1) / (n - 1)) AS pc, r - (r - 1) * (r - 1) / (n - 1) AS rc, q - (q - 1) * (q - 1) / (n - 1) AS qc FROM g),
ct AS (SELECT grp, count(*) AS n, (SELECT count(*) FROM own) AS n_total FROM own GROUP BY 1) SELECT grp AS "group", ct.n, n_total, label, round(phi2 * b.n, 6) AS chi2, round(phi2, 6) AS phi2, round(sqrt(phi2 / (least(r, q) - 1)), 6) AS v, round(sqrt(pc / (least(rc, qc) - 1)), 6) AS v_corrected FROM ct, b""",
    "concordance_index": f"WITH {fx.SURVIVAL}, v AS (SELECT * FROM surv WHERE time > 0) SELECT round(avg(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0.0 END), 8) AS c_index, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM v WHERE event = 1) AS n_events FROM v a JOIN v b ON b.time > a.time WHERE a.event = 1",
    "concordance_stratified": f"WITH {fx.SURVIVAL}, v AS (SELECT * FROM surv WHERE time > 0) SELECT round(avg(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0.0 END), 8) AS c_index, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM v WHERE event = 1) AS n_events FROM v a JOIN v b ON b.time > a.time AND a.stratum = b.stratum WHERE a.event = 1",
    "type_rate_concordance": f"WITH {fx.SURVIVAL}, v AS (SELECT time, event, sum(event) OVER w / sum(time) OVER w AS score FROM surv WHERE time > 0 WINDOW w AS (PARTITION BY stratum)) SELECT round(avg(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0.0 END), 8) AS c_index, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM v WHERE event = 1) AS n_events FROM v a JOIN v b ON b.time > a.time WHERE a.event = 1",
    "preserved_site_split": f"""WITH RECURSIVE {fx.COHORT}, t AS (SELECT site, count(*)::DOUBLE AS n, avg(purity) AS y, md5('0|' || site) AS lot FROM cohort GROUP BY 1), m AS (SELECT sum(n) / 5 AS share, sum(n * y) / sum(n) AS middle FROM t), q AS (SELECT share, middle, sqrt(sum(n * (y - middle) * (y - middle)) / sum(n)) AS spread FROM t, m GROUP BY ALL),
o AS (SELECT site, n, n * (y - middle) AS pull, share, spread, row_number() OVER (ORDER BY n DESC, lot) AS p FROM t, q),
d(p, site, f, size, lean) AS (SELECT 0::BIGINT, NULL::INTEGER, NULL::INTEGER, [0, 0, 0, 0, 0]::DOUBLE[], [0, 0, 0, 0, 0]::DOUBLE[] UNION ALL
SELECT p, site, f, list_transform(range(1, 6), lambda i: size[i] + CASE WHEN i = f + 1 THEN n ELSE 0 END), list_transform(range(1, 6), lambda i: lean[i] + CASE WHEN i = f + 1 THEN pull ELSE 0 END) FROM (
SELECT o.p, o.site, o.n, o.pull, size, lean, list_sort(list_transform(range(1, 6), lambda i: {{'c': round(((size[i] + n) * (size[i] + n) - size[i] * size[i]) / (share * share) + ((lean[i] + pull) * (lean[i] + pull) - lean[i] * lean[i]) / (share * spread * share * spread), 9), 'h': md5('0|' || o.site || '|' || (i - 1)), 'f': CAST(i - 1 AS INTEGER)}}))[1].f AS f FROM d JOIN o ON o.p = d.p + 1))
SELECT patient AS key, f AS fold FROM cohort JOIN d USING (site)""",
    "outcome_arm": f"""WITH {fx.SURVIVAL}, v AS (SELECT * FROM surv WHERE time > 0), s0 AS (SELECT sample, -1 AS draw, score FROM surv UNION ALL SELECT sample, draw, CAST(CAST('0x' || substr(md5('0|' || draw || '|' || sample), 1, 8) AS BIGINT) AS DOUBLE) FROM surv, range(0, 10) AS r(draw)),
f AS (SELECT draw, regr_slope(score, (sample % 1000)::DOUBLE) AS b, avg(score) AS my, avg((sample % 1000)::DOUBLE) AS mx FROM s0 GROUP BY draw), k AS (SELECT 'raw' AS kind, sample, draw, score FROM s0 UNION ALL SELECT 'axis_residualised', sample, draw, score - (my + b * ((sample % 1000)::DOUBLE - mx)) FROM s0 JOIN f USING (draw)),
l AS (SELECT kind, draw, k.score, v.time, v.event, v.stratum FROM k JOIN v USING (sample)), c AS (SELECT kind, draw, sum(won) / sum(pairs) AS c FROM (SELECT a.kind, a.draw, sum(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0.0 END) AS won, count(*) AS pairs FROM l a JOIN l b ON a.kind = b.kind AND a.draw = b.draw AND a.stratum = b.stratum AND b.time > a.time WHERE a.event = 1 GROUP BY ALL) GROUP BY ALL),
z AS (SELECT kind, draw, c, atanh(least(2 * (0.5 + abs(c - 0.5)) - 1, 0.999999)) AS z FROM c), g AS (SELECT kind, avg(z) AS m, stddev_samp(z) AS sd, count(*) AS b FROM z WHERE draw >= 0 GROUP BY kind),
e AS (SELECT z.kind, c, z - m AS x, sqrt(1.0 / ((SELECT count(*) FROM v) - 3) + sd * sd / b) AS se, b FROM z JOIN g USING (kind) WHERE draw = -1)
SELECT 'price' AS set_name, kind AS adjustment, (SELECT count(*) FROM v WHERE event = 1) AS n_events, b AS n_null, round(c, 6) AS observed, round(x, 6) AS excess_z, round(x - {_Z} * se, 6) AS lo, round(x + {_Z} * se, 6) AS hi, round(({_Z} + {_Z80}) * se, 6) AS mde_80pct_z, x - {_Z} * se > 0 AS beats_null FROM e""",
    "label_site_r2": f"""WITH {fx.COHORT}, l AS (SELECT 'purity' AS signature, site, purity AS v FROM cohort UNION ALL SELECT 'patient', site, patient FROM cohort), b AS (SELECT site FROM cohort GROUP BY 1 HAVING count(*) >= 10), x AS (SELECT signature, site, v - avg(v) OVER (PARTITION BY signature) AS d FROM l JOIN b USING (site)),
s AS (SELECT signature, site, count(*) AS n, sum(d) AS s, sum(d * d) AS ss FROM x GROUP BY ALL), g AS (SELECT signature, sum(n) AS n, count(*) AS k, sum(s * s / n) / sum(ss) AS r2 FROM s GROUP BY 1)
SELECT signature, CAST(n AS BIGINT) AS n, k AS n_sites, round(r2, 8) AS r2_site_only, round(1 - (1 - r2) * (n - 1) / (n - k), 8) AS adj_r2_site_only FROM g""",
    "bh_directional": """WITH z AS (SELECT p_partkey AS k, (p_partkey * 7919 % 1009 - 500) / 100.0 AS e, abs((p_partkey * 7919 % 1009 - 500) / 100.0 / (2.0 / (2 * 1.959963984540054))) AS z FROM part), t AS (SELECT *, z / sqrt(2) AS x, 1 / (1 + 0.5 * z / sqrt(2)) AS t FROM z),
p AS (SELECT *, t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))) AS p FROM t),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY z DESC, k) AS q, row_number() OVER (ORDER BY z DESC, k) AS i FROM p), m AS (SELECT coalesce(max(i) FILTER (q <= 0.05), 0) AS m FROM r)
SELECT k AS set_name, round(z, 6) AS z_stat, i <= m AND e > 0 AS beats_null_bh FROM r, m""",
    "auroc_by_site": "WITH x AS (SELECT site, (label = site)::INT AS y, CAST(embedding[1] AS DOUBLE) AS s FROM embeddings, (SELECT DISTINCT label AS site FROM embeddings)), r AS (SELECT site, y, rank() OVER (PARTITION BY site ORDER BY s) + (count(*) OVER (PARTITION BY site, s) - 1) / 2.0 AS r FROM x) SELECT site, CAST(sum(y) AS BIGINT) AS n_patients, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 8) AS auroc FROM r GROUP BY 1",
    "combat_apply": f"WITH {fx.EXPR}, b AS (SELECT label, gene, avg(value) AS m, stddev_pop(value) AS s FROM expr GROUP BY ALL), g AS (SELECT gene, avg(value) AS gm, stddev_pop(value) AS gs FROM expr GROUP BY ALL) SELECT sample AS key, CAST(gene AS INTEGER) AS dim, round((value - m) / s * gs + gm, 6) AS corrected, true AS estimable FROM expr JOIN b USING (label, gene) JOIN g USING (gene)",
    "combat_out_of_fold": f"""WITH {fx.EXPR}, e AS (SELECT *, sample % 5 AS fold FROM expr), k AS (SELECT * FROM range(0, 5) AS r(k)), b AS (SELECT k, label, gene, avg(value) AS m, stddev_pop(value) AS s FROM e, k WHERE fold <> k GROUP BY ALL), g AS (SELECT k, gene, avg(value) AS gm, stddev_pop(value) AS gs FROM e, k WHERE fold <> k GROUP BY ALL)
SELECT sample AS key, CAST(e.gene AS INTEGER) AS dim, round((value - m) / s * gs + gm, 6) AS corrected, true AS estimable FROM e JOIN b ON b.k = fold AND b.label = e.label AND b.gene = e.gene JOIN g ON g.k = fold AND g.gene = e.gene""",
    "r2_single_factor": f"WITH {fx.COHORT}, x AS (SELECT site, purity - (SELECT avg(purity) FROM cohort) AS d FROM cohort), s AS (SELECT site, count(*) AS n, sum(d) AS s, sum(d * d) AS ss FROM x GROUP BY 1), g AS (SELECT sum(n) AS n, count(*) AS k, sum(s * s / n) / sum(ss) AS r2 FROM s) SELECT CAST(n AS BIGINT) AS n, k AS levels, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - k), 8) AS adj_r2 FROM g",
    "permutation_calibration": f"""WITH {fx.COHORT}, {permuted('cohort', 'patient', 'type', 1000)},
x AS (SELECT perm, o.site, c.purity AS y FROM deal JOIN own o USING (type, p) JOIN cohort c ON c.patient = deal.k UNION ALL SELECT -1, site, purity FROM cohort), m AS (SELECT avg(purity) AS m FROM cohort), s AS (SELECT perm, site, count(*) AS n, sum(y - m) AS s, sum((y - m) * (y - m)) AS ss FROM x, m GROUP BY ALL),
r AS (SELECT perm, sum(s * s / n) / sum(ss) AS r2 FROM s GROUP BY perm), o AS (SELECT r2 AS o FROM r WHERE perm = -1)
SELECT round(max(o), 8) AS r2, round(median(r2), 8) AS null_median, round(max(o) - median(r2), 8) AS calibrated, round((1 + count(*) FILTER (r2 >= o)) / (1.0 + count(*)), 8) AS perm_p FROM r, o WHERE perm >= 0""",
    "purity_share": f"WITH {fx.PREDICTED}, g AS (SELECT grp, count(*) AS n, corr(y_true, y_pred) AS a, corr(y_true, other) AS b, corr(y_pred, other) AS c FROM pred GROUP BY 1) SELECT grp AS group, n AS n_share, round(a, 6) AS r_image, round(b, 6) AS r_purity, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS r_partial FROM g",
    "attrition_funnel": """SELECT 'all' AS step, 0 AS place, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_patients FROM orders UNION ALL SELECT 'finished', 1, count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'large', 2, count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 UNION ALL SELECT 'urgent', 3, count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority = '1-URGENT'""",
    "value_spread": "SELECT event_type, count(value) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1",
    "set_size_stats": "WITH s AS (SELECT p_brand, count(DISTINCT p_partkey) AS k FROM part WHERE NOT starts_with(p_brand, 'Brand#1') GROUP BY 1), l AS (SELECT list_sort(list(k)) AS l FROM s) SELECT CAST(len(l) AS INTEGER) AS n_sets, l[1] AS smallest, l[len(l) // 2 + 1] AS upper_median, l[len(l)] AS largest FROM l",
    "nonspace_count": "SELECT n_nationkey, CAST(length(regexp_replace(n_name, '\\s', '', 'g')) AS INTEGER) AS n_chars FROM nation",
    "imputed_features": f"WITH {fx.EXPR}, m AS (SELECT gene, median(value) FILTER ((sample + gene) % 7 <> 0) AS m FROM expr WHERE gene < 48 GROUP BY gene) SELECT sample AS key, round(sum(CASE WHEN (sample + gene) % 7 <> 0 THEN value ELSE m END), 5) AS total FROM expr JOIN m USING (gene) GROUP BY 1",
    "event_moments": "SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY ALL",
    "impute_medians": f"WITH {fx.EXPR} SELECT CAST(gene AS INTEGER) AS pos, round(coalesce(median(value) FILTER ((sample + gene) % 7 <> 0), 0), 6) AS median FROM expr WHERE gene < 48 GROUP BY gene",
}

QUERIES = {
    f.__name__: f
    for f in (
        barcode_annotate, site_summary, sample_mix, collapse_to_patient, assemble_cohort, join_coverage, cohort_overlap, frame_difference, mean_by_patient, first_sample_by_patient, ancestry_keep_first,
        purity_by_patient, cohort_fingerprint, random_folds, fold_balance, group_kfold_unit, preserved_site_split, partition_variance, combat_estimable, fold_change_pairs, sweep_merge, corr_ci_pearson,
        corr_ci_spearman, delta_r, paired_delta_bootstrap, bootstrap_corr, bootstrap_corr_spearman, bh_fdr, cramers_v, cramers_v_perm, group_correlations, contrast_crude, contrast_stratified,
        site_identifiability, composition_share, composition_report, concordance_index, concordance_stratified, type_rate_concordance, cox_score, outcome_arm, label_site_r2, auroc_by_site, combat_apply, combat_out_of_fold,
        r2_single_factor, permutation_calibration, purity_share, r2_ladder, label_site_variance, ridge_oof, ridge_loo_alpha, impute_medians, site_logistic, site_logistic_pair, site_logistic_combat, effective_tests, pooled_bootstrap,
        attrition_funnel, value_spread, set_size_stats, nonspace_count, bh_directional, imputed_features, ancestry_pooled, event_moments,
    )
}
