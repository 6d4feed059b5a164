"""Queries over builds, comparisons of runs, folds, claims and whole audits, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, nulls, outcome, ridge, splits
from ..plans import audit, build, sweep
from ..sources import manifest, tables
from . import fixtures as fx
from .sqlmath import upper_tail
from .matrix import _CLIP, _NULLS, _fit, _null_r


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _genes(spark: SparkSession, d: str) -> DataFrame:
    """A wide genes x samples table: ids with versions, some names shared, some ids without a name."""
    p = fx.table(spark, d, "part")
    return p.select(F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"), F.lit(".2")).alias("id"), F.col("p_partkey").alias("place"), F.col("p_retailprice").alias("s1"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("double")).alias("s2"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part")
    return p.select(F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"))).alias("ensembl_gene_id"), F.concat(F.lit("G"), F.floor(F.col("p_partkey") / 3).cast("string")).alias("symbol"))


def gene_map(spark: SparkSession, d: str) -> DataFrame:
    return tables.derive_gene_map(_names(spark, d))


def expression_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return tables.to_symbols(_genes(spark, d), "id", "place", tables.derive_gene_map(_names(spark, d))).select("sample", "gene", "ordinal", "value")


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as slides, customers' balances as purity and regions as ancestry, vectors' dimensions as expression of samples."""
    o = fx.table(spark, d, "orders")
    slides = o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("slide"), (F.col("o_custkey") % 4).alias("cancer_type"), F.array(F.col("o_totalprice")).alias("vector"))
    c = fx.cohort(spark, d)
    expr = fx.expr(spark, d).select("sample", F.floor(F.col("sample") / 2).alias("patient_id"), "gene", "value")
    return slides, expr, c.select(F.col("patient").alias("patient_id"), "purity"), c.select(F.col("patient").alias("patient_id"), F.col("group").alias("ancestry"))


def _built(cohort: DataFrame, *more: str) -> DataFrame:
    return cohort.select("patient_id", "slide", "n_slides", F.round(F.get("vector", F.lit(0)), 6).alias("v0"), *(F.round(c, 6).alias(c) if c == "purity" else F.col(c) for c in more), *(_r(f"SIG_s{k}") for k in range(4)))


def build_pancancer(spark: SparkSession, d: str) -> DataFrame:
    slides, expr, purity, _ = _raw(spark, d)
    return _built(build.build_cohort(slides, expr, fx.sets(spark), "slide", purity=purity)[0], "purity")


def build_by_ancestry(spark: SparkSession, d: str) -> DataFrame:
    slides, expr, _, ancestry = _raw(spark, d)
    return _built(build.build_cohort(slides, expr, fx.sets(spark), "slide", ancestry=ancestry, groups=["ASIA", "EUROPE"])[0], "ancestry")


def build_first_sample(spark: SparkSession, d: str) -> DataFrame:
    slides, expr, purity, ancestry = _raw(spark, d)
    return _built(build.build_cohort(slides, expr, fx.sets(spark), "slide", purity=purity, ancestry=ancestry, types=[0, 1], how="first")[0], "purity", "ancestry")


def filter_sets(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "part").select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("gene"))
    here = fx.table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("gene"))
    return tables.filter_sets(s, here, 40)[1]


def rescore_cohort(spark: SparkSession, d: str) -> DataFrame:
    cohort = fx.labels(spark, d).select(F.col("sample").alias("patient_id"), "label", F.lit(0.0).alias("s0"), F.lit(0.0).alias("s1"))
    out = compare.rescore(cohort, fx.expr(spark, d), fx.sets(spark).filter("set_name IN ('s0', 's1')"), "ssgsea", ["s0", "s1"])
    return out.select("patient_id", "label", _r("s0"), _r("s1"))


def plan_arms(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for asked in (list(compare.ARMS), ["ssgsea__uncorrected", "mean_z__disattenuated"], ["ssgsea__uncorrected", "mean_z__uncorrected"]):
        p = compare.plan_arms(asked)
        rows.append(("+".join(asked), ",".join(p["selected"]), ",".join(p["skipped"]), ",".join(p["scorers_run"]), ",".join(p["recon_scorers"]), p["complete"], p["agreement_possible"]))
    return spark.createDataFrame(rows, "asked string, selected string, skipped string, scorers_run string, recon_scorers string, complete boolean, agreement_possible boolean")


def _arms(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    p = fx.table(spark, d, "part")
    by = lambda keep, value: p.filter(keep).groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("set_name")).agg(F.avg(value).alias("excess_z"), F.count("*").alias("n"))
    return {"a": by("p_partkey % 3 <> 0", F.col("p_retailprice")), "b": by("p_partkey % 5 <> 0", F.col("p_retailprice") + F.col("p_partkey") % 7)}


def arm_merge(spark: SparkSession, d: str) -> DataFrame:
    m = compare.merge_arms(_arms(spark, d))
    return m.select("set_name", _r("excess_z__a"), "n__a", _r("excess_z__b"), "n__b")


def arm_agreement(spark: SparkSession, d: str) -> DataFrame:
    m = compare.merge_arms(_arms(spark, d)).withColumn("few", F.when(F.col("n__a") > 10**9, F.col("n__a")))
    a = compare.agreement(m, [("excess", "excess_z__a", "excess_z__b"), ("rows", "n__a", "n__b"), ("nothing", "few", "n__b")])
    return a.select("label", "n", _r("pearson"), _r("spearman"), _r("mean_abs_diff"))


def panel_bracket(spark: SparkSession, d: str) -> DataFrame:
    table, rho = compare.panel_bracket(fx.expr(spark, d), fx.sets(spark), (2, 3, 4, 5))
    return table.join(F.broadcast(rho)).select("k", "n_sets", _r("median_gap"), _r("mean_gap"), _r("spearman"))  # one row


def reconstruct_excess(spark: SparkSession, d: str) -> DataFrame:
    own, null = _null_r(spark, d)
    rel = own.select("set_name", F.lit(0.8).alias("observed"), F.when(F.col("set_name") != "s3", 0.6).alias("random"))
    return nulls.reconstruct(own, null, rel)[1].select(_r("isi"), _r("lo"), _r("hi"), "n_signatures", "beats_null")


def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    m = compare.mann_whitney(fx.table(spark, d, "orders").select("o_orderpriority", F.round(F.col("o_totalprice") / 1000).alias("v"), "o_orderstatus"), "v", F.col("o_orderstatus") == "F", "o_orderpriority")
    return m.select("o_orderpriority", "n_first", "n_other", "u", "ties", _r("z"), _r("p_less"), _r("p_two_sided"))


def median_mde(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part").select((F.col("p_size") / 100.0 - 0.2).alias("lo"), (F.col("p_size") / 100.0 + F.col("p_retailprice") / 10000).alias("hi"))
    return compare.median_detectable(p).select(_r("mde_z", 8), _r("mde_c_index", 8))


def stacked_cohorts(spark: SparkSession, d: str) -> DataFrame:
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("mode"))
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("extra"))
    return compare.stack({"customers": c, "suppliers": s}, defaults={"mode": "default"}).select("cohort", "k", "mode", _r("extra"))


def stacked_excess(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers as sets of two cohorts, the second without p, q and the corrected verdict."""
    p = fx.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("set_name"), ((F.col("p_partkey") * 7919 % 1009 - 500) / 200.0).alias("excess_z"))
    s = fx.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("set_name"), (F.col("s_acctbal") / 3000.0).alias("excess_z"))
    both = [x.select("*", (F.col("excess_z") - 1).alias("lo"), (F.col("excess_z") + 1).alias("hi"), (F.col("excess_z") > 1).alias("beats_null")) for x in (p, s)]
    given = both[0].select("*", F.lit(0.5).alias("p"), F.lit(0.6).alias("q"), F.lit(False).alias("beats_null_bh"))
    return compare.stack_excess({"parts": given, "suppliers": both[1]}).select("cohort", "set_name", _r("excess_z"), "beats_null", *(_r(c, 5) for c in ("p", "q")), "beats_null_bh")


def stage_differences(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("value"))
    moved = p.withColumn("value", F.col("value") + F.when(F.col("p_partkey") % 5 == 0, 0.5).otherwise(0.0))
    less = moved.filter("p_partkey % 7 <> 0").withColumn("value", F.when(F.col("p_partkey") % 3 != 0, F.col("value") * 2))
    out = compare.stage_differences({"inputs": (p, p), "scores": (p, moved), "excess": (p, less)}, ["p_partkey"])
    return out.select("stage", "place", "n", "n_missing", _r("max_abs"), _r("max_rel"), "diverges", "first")


def staged_hashes(spark: SparkSession, d: str) -> DataFrame:
    n, c = fx.table(spark, d, "nation"), fx.table(spark, d, "customer")
    return manifest.staged_hashes({"nations": n.select("n_nationkey", "n_name"), "customers": c.select("c_custkey", "c_nationkey", "c_mktsegment"), "segments": c.select(F.col("c_mktsegment").alias("s"))})


def manifest_builds(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.md5(F.col("p_partkey").cast("string")).alias("sha256"), "p_partkey")
    recorded = p.select("path", F.when(F.col("p_partkey") % 2 == 0, F.col("sha256")).otherwise("other").alias("sha256"))
    builds = p.filter("p_partkey % 3 = 0").select("path", "sha256", F.lit("arm").alias("build"))
    diffs = p.filter("p_partkey % 5 = 0").select("path", (F.col("p_partkey") % 25 != 0).alias("exact"), F.when(F.col("p_partkey") % 10 == 5, 0.0).otherwise(1e-13).alias("max_abs_diff"))
    return manifest.verify_builds(p, recorded, builds, diffs)


def bh_tie_audit(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "part").select(F.col("p_partkey").alias("set_name"), F.col("p_brand").alias("family"), (F.col("p_size") / 51.0).alias("p"))
    return nulls.bh_tie_audit(s, family="family").select("family", "n", "n_tied", F.round("max_q_delta", 12).alias("max_q_delta"))


def budget(spark: SparkSession, d: str) -> DataFrame:
    s = fx.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("slides"), (F.col("p_retailprice") / 10).alias("gb"))
    whole = compare.budget(s, "a100").select("p_partkey", F.round("usd_central_low", 6).alias("usd"), F.round("storage_usd", 6).alias("storage_usd"), F.round("days", 6).alias("days"))
    held = compare.budget(s, "a100", streaming=True, batch_slides=5).select("p_partkey", F.round("peak_disk_gb", 6).alias("peak_disk_gb"), F.round("download_hours", 6).alias("download_hours"), F.round("storage_usd", 8).alias("streaming_usd"))
    return whole.join(held, "p_partkey")


def check_claims(spark: SparkSession, d: str) -> DataFrame:
    p = fx.table(spark, d, "part")
    written = F.when(F.col("p_partkey") % 3 == 0, F.format_number("p_retailprice", 1)).when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).otherwise("none")
    texts = p.select(F.col("p_partkey").alias("source"), F.concat(F.lit("The price is "), written, F.lit(" in all.")).alias("text"))
    patterns = spark.createDataFrame([("price", r"price is ([0-9,]+(?:\.[0-9]+)?)")], "name string, pattern string")
    top = p.agg(F.max("p_retailprice").alias("value")).select(F.lit("price").alias("name"), "value")
    return compare.check_claims(texts, patterns, top).select("name", "source", "literal", _r("claimed", 4), _r("value", 4), "status")


def sweep_shards(spark: SparkSession, d: str) -> DataFrame:
    return sweep.shard_of(fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("split_seed")), 4)


def group_kfold_uneven(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_kfold(fx.table(spark, d, "orders"), "o_custkey")


def exact_folds(spark: SparkSession, d: str) -> DataFrame:
    """Fold sizes of the most even assignment of regions' customers to two folds."""
    c = fx.cohort(spark, d)
    s = splits.preserved_site_split(c, "group", "patient", 2, exact=True)
    n = s.folds.groupBy("fold").agg(F.count("*").alias("n"))
    return n.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"))


def endpoint_columns(spark: SparkSession, d: str) -> DataFrame:
    o = fx.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("OS.time"), F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0").alias("OS"))
    e = outcome.endpoint(o, "OS")
    return e.select("o_orderkey", _r("time"), "event", outcome.valid(F.col("time"), F.col("event")).alias("valid"))


def type_proportion_concordance(spark: SparkSession, d: str) -> DataFrame:
    return outcome.type_rate_concordance(fx.survival(spark, d).drop("score"), "stratum", "proportion").select(_r("c_index", 8), "n", "n_events")


def type_hazard_concordance(spark: SparkSession, d: str) -> DataFrame:
    return outcome.type_hazard_concordance(fx.survival(spark, d), "stratum").select(_r("c_index", 8), "n", "n_events")


def outcome_arm_coef(spark: SparkSession, d: str) -> DataFrame:
    from .cohorts import outcome_scores

    own, null, s = outcome_scores(spark, d)
    a = outcome.outcome_arm(own, null, s, metric="coef")
    return a.select("set_name", "adjustment", "metric", "n_events", "n_null", *(_r(c, 5) for c in ("observed", "excess_z")), "beats_null")


def baseline_matrix(spark: SparkSession, d: str) -> DataFrame:
    from .cohorts import predicted_folds

    p = predicted_folds(spark, d)
    b = audit.baselines(p, groups={"site_only": "cluster", "type_only": "stratum"}, numbers={"purity_only": "other"})
    return b.select("set_name", *(_r(c) for c in ("r_site_only", "r_type_only", "r_purity_only")))


def _audit(spark: SparkSession, d: str) -> audit.AuditResult:
    """Vectors as patients: two dimensions predict; those from the ninth on, each with one of the first eight added, are
    genes; the sets are the genes with the same one of four of these."""
    e = fx.table(spark, d, "embeddings")
    v = F.col("embedding").cast("array<double>")
    frame = e.select(F.col("vec_id").alias("patient_id"), F.concat(F.lit("S"), F.pmod(F.col("vec_id"), F.lit(20)).cast("string")).alias("tss"), (F.col("label") % 2).cast("string").alias("cancer_type"), F.get(v, F.lit(0)).alias("purity"), F.array(*(F.get(v, F.lit(k)) for k in (0, 1, 1)), F.get(v, F.lit(0)) * F.get(v, F.lit(1))).alias("x"))
    base = fx.expr(spark, d).filter("gene < 8").select("sample", F.col("gene").alias("k"), F.col("value").alias("shared"))
    own = fx.expr(spark, d).filter("gene >= 8").withColumn("k", F.col("gene") % 8)
    expr = own.join(base, ["sample", "k"]).select("sample", "gene", (F.col("value") + 1.5 * F.col("shared")).alias("value"))
    sets = spark.createDataFrame([(f"s{k}", g) for g in range(8, 64) for k in range(4) if g % 8 == k], "set_name string, gene int")
    return audit.run_audit(frame, expr, sets, audit.AuditConfig(n_null=40, n_boot=200, min_patients=100, with_site_control=False))


def audit_immune_excess(spark: SparkSession, d: str) -> DataFrame:
    t = _audit(spark, d).tables["immune_excess"]
    return t.select("set_name", "n", "n_null", "n_dropped", *(_r(c, 5) for c in ("r_residual_refit", "alpha_observed", "alpha_null_mean", "excess_z", "lo", "hi")), "beats_null", "degenerate")


def audit_primary(spark: SparkSession, d: str) -> DataFrame:
    p = _audit(spark, d).primary
    return spark.createDataFrame([(p["value"], p["lo"], p["hi"], p["n"], p["n_rows"], p["n_draws"])], "value double, lo double, hi double, n long, n_rows long, n_draws long")


def audit_per_signature(spark: SparkSession, d: str) -> DataFrame:
    t = _audit(spark, d).tables["per_signature"]
    return t.select("signature", "n", *(_r(c, 5) for c in ("r_random_patient", "r_preserved_site", "delta_z", "r_site_only", "r_type_only", "r_purity_only")))


def penalty_margin(spark: SparkSession, d: str) -> DataFrame:
    from .cohorts import _blocks

    b = _blocks(spark, d)
    centre = ridge.feature_means(b)
    e = ridge.loo_errors(b, ridge.moments(b, centre), centre, range(5))
    return spark.createDataFrame([(k, round(v[0], 8), round(v[1], 8), round(v[2], 8)) for k, v in sorted(ridge.alpha_margin(e).items())], "fold long, first double, second double, gap double")


_SCORED = "z2 AS (SELECT e.p AS sample, e.gene, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM e WINDOW w AS (PARTITION BY e.gene)), sc AS (SELECT sample, set_name, avg(z) AS score FROM z2 JOIN sets USING (gene) GROUP BY ALL), w AS (SELECT sample, max(score) FILTER (set_name = 's0') AS s0, max(score) FILTER (set_name = 's1') AS s1, max(score) FILTER (set_name = 's2') AS s2, max(score) FILTER (set_name = 's3') AS s3 FROM sc GROUP BY 1)"


def _build_sql(keep: str, expr: str, more: str, types: str = "true") -> str:
    return f"""WITH {fx.EXPR}, {fx.SETS_SQL}, {fx.COHORT},
sl AS (SELECT o_custkey AS k, min(o_orderkey) AS slide, count(*) AS n_slides, avg(o_totalprice) AS v0 FROM orders WHERE {types} GROUP BY 1), x AS ({expr}),
pt AS (SELECT sl.*, purity, grp AS ancestry FROM sl LEFT JOIN cohort ON patient = k WHERE {keep} AND k IN (SELECT p FROM x)), e AS (SELECT * FROM x WHERE p IN (SELECT k FROM pt)), {_SCORED}
SELECT k AS patient_id, slide, n_slides, round(v0, 6) AS v0, {more}, round(s0, 6) AS "SIG_s0", round(s1, 6) AS "SIG_s1", round(s2, 6) AS "SIG_s2", round(s3, 6) AS "SIG_s3" FROM pt LEFT JOIN w ON w.sample = k"""


_MEAN = "SELECT sample // 2 AS p, gene, avg(value) AS value FROM expr GROUP BY ALL"
_FIRST = "SELECT sample // 2 AS p, gene, value FROM expr WHERE sample IN (SELECT min(sample) FROM expr GROUP BY sample // 2)"
_ARM = "SELECT p_brand || '/' || p_size AS set_name, avg({1}) AS z, count(*) AS n FROM part WHERE {0} GROUP BY 1"
_TWO_ARMS = f"a AS ({_ARM.format('p_partkey % 3 <> 0', 'p_retailprice')}), b AS ({_ARM.format('p_partkey % 5 <> 0', 'p_retailprice + p_partkey % 7')}), m AS (SELECT coalesce(a.set_name, b.set_name) AS set_name, a.z AS za, a.n AS na, b.z AS zb, b.n AS nb FROM a FULL JOIN b ON a.set_name = b.set_name)"
_Z, _Z80 = 1.959963984540054, 0.8416212335729143


def _tree(rows: str) -> str:
    """The hash tree of rows' hashes h, level by level."""
    two = lambda inner, digits: f"SELECT left(h, {digits}) || sha256(string_agg(h, '' ORDER BY h)) AS h, sum(n) AS n FROM ({inner}) GROUP BY left(h, {digits})"
    return two(two(two(rows, 4), 2), 0)


ORACLE_SQL = {
    "gene_map": "SELECT 'ENSG' || p_partkey AS gene_id, 'G' || (p_partkey // 3) AS symbol FROM part WHERE p_partkey % 4 <> 0",
    "expression_by_symbol": """WITH n AS (SELECT p_partkey AS k, 'G' || (p_partkey // 3) AS gene, row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 4 <> 0), f AS (SELECT k, gene FROM n WHERE r = 1)
SELECT 's1' AS sample, gene, k AS ordinal, p_retailprice AS value FROM f JOIN part ON p_partkey = k UNION ALL SELECT 's2', gene, k, CASE WHEN k % 3 <> 0 THEN CAST(p_size AS DOUBLE) END FROM f JOIN part ON p_partkey = k""",
    "build_pancancer": _build_sql("true", _MEAN, "round(purity, 6) AS purity"),
    "build_by_ancestry": _build_sql("grp IN ('ASIA', 'EUROPE')", _MEAN, "ancestry"),
    "build_first_sample": _build_sql("true", _FIRST, "round(purity, 6) AS purity, ancestry", "o_custkey % 4 IN (0, 1)"),
    "filter_sets": "SELECT p_brand AS set_name, count(*) AS n, count(*) FILTER (p_size > 25) AS n_present, count(*) FILTER (p_size > 25) >= 40 AS kept FROM part GROUP BY 1",
    "rescore_cohort": f"""WITH {fx.EXPR}, {fx.SETS_SQL}, t AS (SELECT sample, gene, pow(rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0, 0.25) AS w,
  count(*) OVER (PARTITION BY sample) - row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) + 1 AS d, count(*) OVER (PARTITION BY sample) AS n FROM expr),
s AS (SELECT sample, set_name, (sum(w * d) / sum(w) - (max(n) * (max(n) + 1) / 2.0 - sum(d)) / (max(n) - count(*))) / max(n) AS score FROM t JOIN sets USING (gene) GROUP BY ALL)
SELECT vec_id AS patient_id, label, round(max(score) FILTER (set_name = 's0'), 6) AS s0, round(max(score) FILTER (set_name = 's1'), 6) AS s1 FROM embeddings JOIN s ON sample = vec_id GROUP BY 1, 2""",
    "plan_arms": """SELECT * FROM (VALUES ('mean_z__disattenuated+mean_z__uncorrected+ssgsea__disattenuated+ssgsea__uncorrected', 'mean_z__disattenuated,mean_z__uncorrected,ssgsea__disattenuated,ssgsea__uncorrected', '', 'mean_z,ssgsea', 'mean_z,ssgsea', true, true),
('ssgsea__uncorrected+mean_z__disattenuated', 'mean_z__disattenuated,ssgsea__uncorrected', 'mean_z__uncorrected,ssgsea__disattenuated', 'mean_z,ssgsea', 'ssgsea', false, false),
('ssgsea__uncorrected+mean_z__uncorrected', 'mean_z__uncorrected,ssgsea__uncorrected', 'mean_z__disattenuated,ssgsea__disattenuated', 'mean_z,ssgsea', 'mean_z,ssgsea', false, true)) t(asked, selected, skipped, scorers_run, recon_scorers, complete, agreement_possible)""",
    "arm_merge": f"WITH {_TWO_ARMS} SELECT set_name, round(za, 6) AS excess_z__a, na AS n__a, round(zb, 6) AS excess_z__b, nb AS n__b FROM m",
    "arm_agreement": f"""WITH {_TWO_ARMS}, l AS (SELECT 'excess' AS label, za AS a, zb AS b FROM m UNION ALL SELECT 'rows', na, nb FROM m), c AS (SELECT * FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY a) + (count(*) OVER (PARTITION BY label, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY label ORDER BY b) + (count(*) OVER (PARTITION BY label, b) - 1) / 2.0 AS rb FROM c)
SELECT label, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(abs(a - b)), 6) AS mean_abs_diff FROM r GROUP BY label UNION ALL SELECT 'nothing', 0, NULL, NULL, NULL""",
    "panel_bracket": f"""WITH {fx.EXPR}, {fx.SETS_SQL}, g AS (SELECT DISTINCT gene FROM expr), a AS (SELECT set_name, k FROM (SELECT DISTINCT set_name FROM sets), (SELECT unnest([2, 3, 4]) AS k)),
c AS (SELECT 'own' AS side, a.set_name, k, gene FROM a JOIN sets USING (set_name) UNION ALL SELECT 'any', set_name, k, gene FROM a, g),
o AS (SELECT *, row_number() OVER (PARTITION BY side, set_name, k ORDER BY md5('0|' || side || '|' || set_name || '|' || k || '|' || gene), gene) AS p FROM c), t AS (SELECT * FROM o WHERE p <= k),
z AS (SELECT sample, gene, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM expr WINDOW w AS (PARTITION BY gene)), s AS (SELECT side, set_name, k, sample, sum(z) AS s FROM t JOIN z USING (gene) GROUP BY ALL),
r AS (SELECT side, set_name, k, (var_samp(s) - k) / (k * (k - 1)) AS rho FROM s GROUP BY side, set_name, k), al AS (SELECT *, CASE WHEN rho <= 0 THEN 0 ELSE k * rho / (1 + (k - 1) * rho) END AS alpha FROM r),
d AS (SELECT set_name, k, max(alpha) FILTER (side = 'own') - max(alpha) FILTER (side = 'any') AS gap FROM al GROUP BY ALL), b AS (SELECT k, count(*) AS n_sets, median(gap) AS m, avg(gap) AS mean FROM d GROUP BY k),
q AS (SELECT corr(x, y) AS rho FROM (SELECT rank() OVER (ORDER BY k) AS x, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS y FROM b))
SELECT CAST(k AS INTEGER) AS k, n_sets, round(m, 6) AS median_gap, round(mean, 6) AS mean_gap, round(rho, 6) AS spearman FROM b, q""",
    "reconstruct_excess": _fit(_NULLS) + f""", o AS (SELECT set_name, n, r / sqrt(0.8) AS r FROM own WHERE set_name <> 's3'), q AS (SELECT set_name, r / sqrt(0.6) AS r FROM null_r),
s AS (SELECT set_name, count(*) FILTER (abs(r) < 1) AS b, avg({_CLIP.format('r')}) FILTER (abs(r) < 1) AS m, stddev_samp({_CLIP.format('r')}) FILTER (abs(r) < 1) AS sd FROM q GROUP BY set_name),
e AS (SELECT {_CLIP.format('o.r')} - m AS x, sqrt(1.0 / greatest(n - 3, 1) + sd * sd / b) AS se FROM o JOIN s USING (set_name)), g AS (SELECT avg(x) AS isi, stddev_samp(x) / sqrt(count(*)) AS se, count(*) AS n, count(*) FILTER (x - {_Z} * e.se > 0) AS b FROM e)
SELECT round(isi, 6) AS isi, round(isi - {_Z} * se, 6) AS lo, round(isi + {_Z} * se, 6) AS hi, n AS n_signatures, b AS beats_null FROM g""",
    "mann_whitney": """WITH v AS (SELECT o_orderpriority AS p, round(o_totalprice / 1000) AS v, o_orderstatus = 'F' AS f FROM orders), r AS (SELECT *, rank() OVER (PARTITION BY p ORDER BY v) + (count(*) OVER (PARTITION BY p, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY p, v) AS t FROM v),
g AS (SELECT p, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b, sum(r) FILTER (f) AS rs, sum(t * t - 1.0) AS ties FROM r GROUP BY 1), u AS (SELECT *, rs - a * (a + 1) / 2.0 AS u, a + b AS n FROM g),
q AS (SELECT *, abs(u - a * b / 2.0) AS d, sqrt(a * b / 12.0 * (n + 1 - ties / (n * (n - 1.0)))) AS sd FROM u), w AS (SELECT *, greatest(d - 0.5, 0) / sd AS z, (CASE WHEN u <= a * b / 2.0 THEN d - 0.5 ELSE -d - 0.5 END) / sd AS zl, (d - 0.5) / sd AS zt FROM q)
SELECT p AS o_orderpriority, a AS n_first, b AS n_other, u, CAST(ties AS DOUBLE) AS ties, round(sign(u - a * b / 2.0) * z, 6) AS z, round(""" + upper_tail("zl") + ", 6) AS p_less, round(least(1, 2 * " + upper_tail("zt") + "), 6) AS p_two_sided FROM w",
    "median_mde": f"WITH z AS (SELECT median((p_retailprice / 10000 + 0.2) / (2 * {_Z}) * ({_Z} + {_Z80})) AS z FROM part) SELECT round(z, 8) AS mde_z, round(tanh(z) / 2, 8) AS mde_c_index FROM z",
    "stacked_cohorts": "SELECT 'customers' AS cohort, c_custkey AS k, c_mktsegment AS mode, CAST(NULL AS DOUBLE) AS extra FROM customer UNION ALL SELECT 'suppliers', s_suppkey, 'default', round(s_acctbal, 6) FROM supplier",
    "stacked_excess": f"""WITH s AS (SELECT 's' || s_suppkey AS k, s_acctbal / 3000.0 AS e, abs(s_acctbal / 3000.0) * {_Z} AS z FROM supplier), t AS (SELECT *, 2 * {upper_tail("z")} AS p FROM s), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, k) AS raw, row_number() OVER (ORDER BY p, k) AS i FROM t),
q AS (SELECT *, least(1, min(raw) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT 'suppliers' AS cohort, k AS set_name, round(e, 6) AS excess_z, e > 1 AS beats_null, round(round(p * fp) / fp, 5) AS p, round(round(q * fq) / fq, 5) AS q, q <= 0.05 AND e > 0 AS beats_null_bh FROM (SELECT *, pow(10.0, 5 - floor(log10(p))) AS fp, pow(10.0, 5 - floor(log10(q))) AS fq FROM q)
UNION ALL SELECT 'parts', 'p' || p_partkey, round((p_partkey * 7919 % 1009 - 500) / 200.0, 6), (p_partkey * 7919 % 1009 - 500) / 200.0 > 1, 0.5, 0.6, false FROM part""",
    "stage_differences": """WITH m AS (SELECT p_partkey AS k, p_retailprice AS v, p_retailprice + CASE WHEN p_partkey % 5 = 0 THEN 0.5 ELSE 0 END AS w FROM part), l AS (SELECT k, CASE WHEN k % 3 <> 0 THEN w * 2 END AS w FROM m WHERE k % 7 <> 0),
s AS (SELECT 'inputs' AS stage, 0 AS place, count(*) AS n, 0 AS n_missing, 0.0 AS a, 0.0 AS r FROM m UNION ALL SELECT 'scores', 1, count(*), 0, max(abs(v - w)), max(abs(v - w) / abs(v)) FROM m
UNION ALL SELECT 'excess', 2, count(l.w), count(*) FILTER (l.k IS NULL), max(abs(v - l.w)), max(abs(v - l.w) / abs(v)) FROM m LEFT JOIN l ON l.k = m.k)
SELECT stage, CAST(place AS INTEGER) AS place, n, CAST(n_missing AS BIGINT) AS n_missing, round(CAST(a AS DOUBLE), 6) AS max_abs, round(CAST(r AS DOUBLE), 6) AS max_rel, place > 0 AS diverges, place = 1 AS first FROM s""",
    "cohort_fingerprint": f"""WITH a AS ({_tree('''SELECT sha256('{"k":"' || k || '"}') AS h, 1 AS n FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer)''')}) SELECT h AS fingerprint, CAST(n AS BIGINT) AS n FROM a""",
    "staged_hashes": f"""WITH a AS ({_tree('''SELECT sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS h, 1 AS n FROM nation''')}), b AS ({_tree('''SELECT sha256('{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}') AS h, 1 AS n FROM customer''')}), c AS ({_tree('''SELECT sha256('{"s":"' || c_mktsegment || '"}') AS h, 1 AS n FROM customer''')})
SELECT 'nations' AS stage, CAST(0 AS INTEGER) AS place, CAST(n AS BIGINT) AS n, h AS sha256 FROM a UNION ALL SELECT 'customers', 1, CAST(n AS BIGINT), h FROM b UNION ALL SELECT 'segments', 2, CAST(n AS BIGINT), h FROM c""",
    "manifest_builds": "SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 2 = 0 THEN 'BYTE-IDENTICAL' WHEN p_partkey % 3 = 0 THEN 'KNOWN BUILD arm' WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 25 = 0 THEN 'CONTENT DIFFERS' WHEN p_partkey % 10 = 5 THEN 'CONTENT-EQUAL' ELSE 'NUMERICALLY EQUAL' END ELSE 'BYTES DIFFER' END AS verdict FROM part",
    "bh_tie_audit": "SELECT f AS family, CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS n_tied, 0.0::DOUBLE AS max_q_delta FROM (SELECT p_brand AS f, p_size, count(*) AS c FROM part GROUP BY ALL) GROUP BY f",
    "budget": "SELECT p_partkey, round(p_size / 14.6 * 1.07, 6) AS usd, round(p_retailprice / 10 * 0.1, 6) AS storage_usd, round(p_size / 14.6 / 24, 6) AS days, round(p_retailprice / 10 * 5 / p_size, 6) AS peak_disk_gb, round(p_retailprice / 10 * 1024 / 50 / 3600, 6) AS download_hours, round(p_retailprice / 10 * 5 / p_size * 0.1 * (p_size / 14.6 / 720), 8) AS streaming_usd FROM part",
    "check_claims": """WITH t AS (SELECT max(p_retailprice) AS v FROM part), l AS (SELECT p_partkey AS source, CASE p_partkey % 3 WHEN 0 THEN format('{:,.1f}', p_retailprice) WHEN 1 THEN CAST(p_size AS VARCHAR) END AS literal FROM part), c AS (SELECT *, CAST(replace(literal, ',', '') AS DOUBLE) AS x FROM l)
SELECT 'price' AS name, source, literal, round(x, 4) AS claimed, round(v, 4) AS value, CASE WHEN literal IS NULL THEN 'ABSENT' WHEN abs(x - v) <= CASE WHEN contains(literal, '.') THEN 0.05 + 1e-12 ELSE 0.5 END THEN 'OK' ELSE 'MISMATCH' END AS status FROM c, t""",
    "sweep_shards": "SELECT s_suppkey AS split_seed, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) * 4 // (SELECT count(*) FROM supplier) AS INTEGER) AS shard FROM supplier",
    "group_kfold_uneven": """WITH RECURSIVE g AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k DESC) AS p FROM g),
d(p, k, f, loads) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::INTEGER, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL SELECT o.p, o.k, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER), list_transform(range(1, 6), lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END) FROM d JOIN o ON o.p = d.p + 1)
SELECT k AS o_custkey, f AS fold FROM d WHERE p > 0""",
    "exact_folds": f"""WITH {fx.COHORT}, s AS (SELECT n, row_number() OVER (ORDER BY grp) - 1 AS i FROM (SELECT grp, count(*) AS n FROM cohort GROUP BY 1)), t AS (SELECT sum(n) AS t FROM s), c AS (SELECT m, sum(n) FILTER ((m >> i) & 1 = 1) AS a FROM range(1, (1 << (SELECT CAST(count(*) AS INTEGER) FROM s)) - 1) AS r(m), s GROUP BY m)
SELECT CAST(min(greatest(a, t - a)) AS BIGINT) AS largest, CAST(max(least(a, t - a)) AS BIGINT) AS smallest FROM c, t""",
    "endpoint_columns": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice, 6) END AS time, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS event, o_orderkey % 3 <> 0 AND o_totalprice > 0 AND o_orderstatus IN ('F', 'O') AS valid FROM orders",
    "type_proportion_concordance": f"WITH {fx.SURVIVAL}, v AS (SELECT time, event, avg(event) OVER (PARTITION BY stratum) AS score FROM surv WHERE time > 0) SELECT round(avg(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0.0 END), 8) AS c_index, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM v WHERE event = 1) AS n_events FROM v a JOIN v b ON b.time > a.time WHERE a.event = 1",
    "baseline_matrix": f"""WITH {fx.PREDICTED}, l AS (SELECT cluster, stratum, other, cluster % 5 AS fold, unnest(['y_true', 'y_pred']) AS set_name, unnest([CAST(y_true AS DOUBLE), CAST(y_pred AS DOUBLE)]) AS y FROM pred),
a AS (SELECT *, sum(y) OVER g - sum(y) OVER gf AS s1, count(*) OVER g - count(*) OVER gf AS n1, sum(y) OVER t - sum(y) OVER tf AS s2, count(*) OVER t - count(*) OVER tf AS n2, sum(y) OVER w - sum(y) OVER wf AS s3, count(*) OVER w - count(*) OVER wf AS n3, sum(other) OVER w - sum(other) OVER wf AS sx, sum(other * other) OVER w - sum(other * other) OVER wf AS sxx, sum(other * y) OVER w - sum(other * y) OVER wf AS sxy FROM l
WINDOW g AS (PARTITION BY set_name, cluster), gf AS (PARTITION BY set_name, cluster, fold), t AS (PARTITION BY set_name, stratum), tf AS (PARTITION BY set_name, stratum, fold), w AS (PARTITION BY set_name), wf AS (PARTITION BY set_name, fold)),
b AS (SELECT set_name, y, CASE WHEN n1 > 0 THEN s1 / n1 ELSE s3 / n3 END AS b1, CASE WHEN n2 > 0 THEN s2 / n2 ELSE s3 / n3 END AS b2, s3 / n3 + (sxy - sx * s3 / n3) / (sxx - sx * sx / n3) * (other - sx / n3) AS b3 FROM a)
SELECT set_name, CASE WHEN stddev_pop(b1) > 0 THEN round(corr(y, b1), 6) END AS r_site_only, round(corr(y, b2), 6) AS r_type_only, round(corr(y, b3), 6) AS r_purity_only FROM b GROUP BY 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        gene_map, expression_by_symbol, build_pancancer, build_by_ancestry, build_first_sample, filter_sets, rescore_cohort, plan_arms, arm_merge, arm_agreement, panel_bracket, reconstruct_excess, mann_whitney, median_mde,
        stacked_cohorts, stacked_excess, stage_differences, staged_hashes, manifest_builds, bh_tie_audit, budget, check_claims, sweep_shards, group_kfold_uneven, exact_folds, endpoint_columns, type_proportion_concordance,
        type_hazard_concordance, outcome_arm_coef, baseline_matrix, audit_immune_excess, audit_primary, audit_per_signature, penalty_margin,
    )
}
