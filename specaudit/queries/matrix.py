"""Queries over the sample x gene matrix: scores, axis, residuals, reliabilities, random sets, excess."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import corr_interval, disattenuate, expected_random_set_correlation, fisher_z, n_pairs, pearson
from ..operators import axis as axes
from ..operators import nulls, scoring
from ..functions.dealing import ALL_BINS
from . import fixtures as fx
from .sqlmath import deal_key, dealt, drawn


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_mean_z(fx.expr(spark, d), fx.sets(spark))


def _axis(spark: SparkSession, d: str) -> DataFrame:
    return axes.global_axis_mean_z(fx.expr(spark, d)).join(fx.labels(spark, d), "sample")


def score_mean_z(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("sample", "set_name", _r("score"))


def score_ssgsea(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_ssgsea(fx.expr(spark, d), fx.sets(spark)).select("sample", "set_name", _r("score"))


def score_plage(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_plage(fx.expr(spark, d), fx.sets(spark)).select("sample", "set_name", _r("score"))


def global_axis_mean_z(spark: SparkSession, d: str) -> DataFrame:
    return _axis(spark, d).select("sample", _r("axis"))


def global_axis_pc1(spark: SparkSession, d: str) -> DataFrame:
    groups = fx.labels(spark, d).select("sample", F.col("type").alias("group"))
    return axes.global_axis_pc1(fx.expr(spark, d), groups).select("sample", "group", _r("axis"), _r("variance_explained"))


def axis_top_loadings(spark: SparkSession, d: str) -> DataFrame:
    return axes.top_loadings(fx.expr(spark, d), _axis(spark, d), 10).select("gene", _r("loading"))


def residualise_within(spark: SparkSession, d: str) -> DataFrame:
    return axes.residualise(_scores(spark, d), _axis(spark, d), within="type").select("sample", "set_name", _r("residual"))


def residual_item_variances(spark: SparkSession, d: str) -> DataFrame:
    return axes.residual_item_variances(fx.expr(spark, d), _axis(spark, d)).select("gene", _r("variance"))


def three_way_report(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: scores, their residuals within type, and a predictor's correlations with Fisher intervals."""
    r = axes.three_way(_scores(spark, d), _axis(spark, d), fx.gene(spark, d, 0, "prediction"), within="type")
    lo, hi = corr_interval(F.col("r_residual"), F.col("n"))
    return r.select("set_name", _r("r_raw"), _r("r_axis"), _r("r_residual"), F.round(fisher_z(F.col("r_residual")), 6).alias("z_residual"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), "n")


def cronbach_alpha(spark: SparkSession, d: str) -> DataFrame:
    return scoring.cronbach_alpha(fx.expr(spark, d), fx.sets(spark)).select("set_name", "k", "n", _r("rho"), _r("alpha"))


def alpha_from_scores(spark: SparkSession, d: str) -> DataFrame:
    sizes = fx.sets(spark).groupBy("set_name").agg(F.count("*").alias("k"))
    return scoring.alpha_from_scores(_scores(spark, d), sizes).select("set_name", "k", "n", _r("alpha"))


def alpha_residual(spark: SparkSession, d: str) -> DataFrame:
    axis = _axis(spark, d)
    own = axes.residualise(_scores(spark, d), axis).select("sample", "set_name", F.col("residual").alias("score"))
    v = axes.residual_item_variances(scoring.z_scores(fx.expr(spark, d)).withColumnRenamed("z", "value"), axis)
    return scoring.alpha_from_item_variances(own, fx.sets(spark), v).select("set_name", "k", _r("alpha"))


def split_half(spark: SparkSession, d: str) -> DataFrame:
    return scoring.split_half_reliability(fx.expr(spark, d), fx.sets(spark), n_splits=5).select("set_name", _r("r_half"), _r("reliability"))


def omega(spark: SparkSession, d: str) -> DataFrame:
    return scoring.omega_reliability(fx.expr(spark, d), fx.sets(spark)).select("set_name", "k", _r("omega"))


def tie_audit(spark: SparkSession, d: str) -> DataFrame:
    rounded = fx.expr(spark, d).withColumn("value", F.round("value", 1))
    return scoring.tie_audit(rounded)


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return nulls.level_bins(fx.table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("level")))


def _brands(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select(F.col("p_brand").alias("set_name"), F.col("p_partkey").alias("gene"))


def gene_qcut_bins(spark: SparkSession, d: str) -> DataFrame:
    return _bins(spark, d).select("gene", "bin")


def bin_histogram(spark: SparkSession, d: str) -> DataFrame:
    return nulls.bin_histogram(_brands(spark, d), _bins(spark, d))


def random_sets_matched(spark: SparkSession, d: str) -> DataFrame:
    return nulls.random_sets(_brands(spark, d), _bins(spark, d), n_draws=100)


def random_sets_size_only(spark: SparkSession, d: str) -> DataFrame:
    return nulls.random_sets(_brands(spark, d), _bins(spark, d), n_draws=100, matched=False)


def random_sets_short(spark: SparkSession, d: str) -> DataFrame:
    """Sets that ask for twice the genes of their bins: those of the lower bins, each listed twice."""
    bins = _bins(spark, d)
    low = bins.filter("bin < 4").select(F.concat(F.lit("low"), F.pmod("gene", F.lit(2)).cast("string")).alias("set_name"), "gene")
    thrice = low.unionAll(low).unionAll(low)
    return nulls.random_sets(thrice, bins, n_draws=3)


def _null_r(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Correlation of each set's score with gene 0, and of each of the first 48 genes with it, as 48 null draws."""
    own = _scores(spark, d).join(fx.gene(spark, d, 1, "p"), "sample").groupBy("set_name").agg(pearson(F.col("score"), F.col("p")).alias("r"), F.count("*").alias("n"))
    null = fx.expr(spark, d).filter("gene BETWEEN 2 AND 47").join(fx.gene(spark, d, 1, "p"), "sample").groupBy(F.col("gene").alias("draw")).agg(pearson(F.col("value"), F.col("p")).alias("r"))
    names = fx.sets(spark).select("set_name").distinct()
    return own, null.select("draw", "r", F.explode(F.array(*(F.lit(s) for s in fx.SETS))).alias("set_name")).join(F.broadcast(names), "set_name", "left_semi")


def null_percentile(spark: SparkSession, d: str) -> DataFrame:
    own, null = _null_r(spark, d)
    return nulls.null_percentile(own.select("set_name", F.col("r").alias("observed")), null.select("set_name", F.col("r").alias("value"))).select("set_name", _r("percentile"))


def null_degeneracy(spark: SparkSession, d: str) -> DataFrame:
    g = nulls.null_degeneracy(_null_r(spark, d)[1], "r")
    return g.select("set_name", "n", *(_r(c) for c in ("mean", "sd", "min", "max", "range", "z_sd")), "degenerate")


def excess_over_null(spark: SparkSession, d: str) -> DataFrame:
    own, null = _null_r(spark, d)
    own, null = own.withColumn("reliability", F.lit(0.8)), null.withColumn("reliability", F.lit(0.6))
    return nulls.excess_over_null(own, null).select("set_name", *(_r(c) for c in ("excess_z", "lo", "hi", "se")), "n_null", "n_dropped", "beats_null")


def null_summary(spark: SparkSession, d: str) -> DataFrame:
    own, null = _null_r(spark, d)
    return nulls.null_summary(own, null).select("set_name", *(_r(c) for c in ("excess_z", "null_mean", "null_sd", "percentile")), "n_null", "null_degenerate")


def rotation_null(spark: SparkSession, d: str) -> DataFrame:
    own, null = _null_r(spark, d)
    return nulls.rotation_null(null, own).select(*(_r(c) for c in ("observed", "null_mean", "null_sd", "null_lo", "null_hi", "p")), "n_draws")


def disattenuation(spark: SparkSession, d: str) -> DataFrame:
    g = fx.expr(spark, d).join(fx.gene(spark, d, 0, "p"), "sample").groupBy("gene").agg(pearson(F.col("value"), F.col("p")).alias("r"), n_pairs(F.col("value"), F.col("p")).alias("n"))
    rel = F.col("gene") / 64
    return g.select("gene", F.round(disattenuate(F.col("r"), rel), 6).alias("r_corrected"), F.round(expected_random_set_correlation(F.lit(4), rel), 6).alias("expected"))


def _fit(*extra: str) -> str:
    return f"WITH {fx.MATRIX}" + "".join(f",\n{x}" for x in extra)


_PRED = "p0 AS (SELECT sample, value AS p FROM expr WHERE gene = 0), p1 AS (SELECT sample, value AS p FROM expr WHERE gene = 1)"
_NULLS = f"""{_PRED},
own AS (SELECT set_name, corr(score, p) AS r, count(*) AS n FROM scores JOIN p1 USING (sample) GROUP BY ALL),
null_r AS (SELECT set_name, gene AS draw, r FROM (SELECT gene, corr(value, p) AS r FROM expr JOIN p1 USING (sample) WHERE gene BETWEEN 2 AND 47 GROUP BY ALL), (SELECT DISTINCT set_name FROM sets))"""
_CLIP = "atanh(greatest(least({0}, 0.999999), -0.999999))"
_ZN = 1.959963984540054

_BINS = "bins AS (SELECT p_partkey AS gene, greatest(CAST(ceil((r - 1) * 10.0 / (n - 1)) AS BIGINT) - 1, 0) AS bin FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part))"
_HIST = "want AS (SELECT p_brand AS set_name, bin, count(*) AS want FROM part JOIN bins ON p_partkey = gene GROUP BY ALL)"

#: Leading eigenvectors by squaring the cross products again and again until one direction is left.
_SQUARINGS = 14
_LEADING = "WITH {long}, gram AS MATERIALIZED (SELECT a.grp, a.gene AS i, b.gene AS j, sum(a.z * b.z) AS v FROM x a JOIN x b USING (grp, sample) GROUP BY ALL),\ntr AS (SELECT grp, sum(v) AS total FROM gram WHERE i = j GROUP BY grp), t0 AS (SELECT grp, i, j, v / total AS v FROM gram JOIN tr USING (grp)),\n" + ",\n".join(
    f"q{k} AS (SELECT a.grp, a.i, b.j, sum(a.v * b.v) AS v FROM t{k} a JOIN t{k} b ON a.grp = b.grp AND a.j = b.i GROUP BY ALL), t{k + 1} AS MATERIALIZED (SELECT grp, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY grp) AS v FROM q{k})" for k in range(_SQUARINGS)
) + f""",
top AS (SELECT grp, max_by(i, v) AS i, max(v) AS d FROM t{_SQUARINGS} WHERE i = j GROUP BY grp), raw AS (SELECT t.grp, t.j AS gene, t.v / sqrt(top.d) AS v FROM t{_SQUARINGS} t JOIN top ON t.grp = top.grp AND t.i = top.i),
vec AS (SELECT grp, gene, v * CASE WHEN sum(v) OVER (PARTITION BY grp) < 0 THEN -1 ELSE 1 END AS v FROM raw),
val AS (SELECT grp, sum(a.v * gram.v * b.v) AS value, max(total) AS total FROM gram JOIN vec a USING (grp) JOIN vec b USING (grp) JOIN tr USING (grp) WHERE a.gene = i AND b.gene = j GROUP BY grp)"""

QUERIES = {
    f.__name__: f
    for f in (
        score_mean_z, score_ssgsea, score_plage, global_axis_mean_z, global_axis_pc1, axis_top_loadings, residualise_within, residual_item_variances, three_way_report, cronbach_alpha,
        alpha_from_scores, alpha_residual, split_half, omega, tie_audit, gene_qcut_bins, bin_histogram, random_sets_matched, random_sets_size_only, random_sets_short, null_percentile, null_degeneracy,
        excess_over_null, null_summary, rotation_null, disattenuation,
    )
}

ORACLE_SQL = {
    "score_mean_z": _fit() + " SELECT sample, set_name, round(score, 6) AS score FROM scores",
    "score_ssgsea": f"""WITH {fx.EXPR}, {fx.SETS_SQL},
t AS (SELECT sample, gene, pow(rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2.0, 0.25) AS w,
  count(*) OVER (PARTITION BY sample) - row_number() OVER (PARTITION BY sample ORDER BY value DESC, gene) + 1 AS d, count(*) OVER (PARTITION BY sample) AS n FROM expr)
SELECT sample, set_name, round((sum(w * d) / sum(w) - (max(n) * (max(n) + 1) / 2.0 - sum(d)) / (max(n) - count(*))) / max(n), 6) AS score FROM t JOIN sets USING (gene) GROUP BY ALL""",
    "global_axis_mean_z": _fit() + " SELECT sample, round(axis, 6) AS axis FROM axis",
    "global_axis_pc1": _LEADING.format(long=f"{fx.EXPR}, x AS (SELECT sample, CAST(label % 2 AS VARCHAR) AS grp, gene, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM expr WINDOW w AS (PARTITION BY label % 2, gene))") + """
SELECT sample, x.grp AS "group", round(sum(z * v), 6) AS axis, round(max(value / total), 6) AS variance_explained FROM x JOIN vec USING (grp, gene) JOIN val USING (grp) GROUP BY ALL""",
    "score_plage": _LEADING.format(long=f"{fx.MATRIX}, x AS (SELECT sample, set_name AS grp, gene, z FROM z JOIN sets USING (gene))") + """
SELECT sample, x.grp AS set_name, round(sum(z * v / sqrt(value)), 6) AS score FROM x JOIN vec USING (grp, gene) JOIN val USING (grp) GROUP BY ALL""",
    "axis_top_loadings": _fit() + " SELECT gene, round(r, 6) AS loading FROM (SELECT gene, corr(z, axis) AS r FROM z JOIN axis USING (sample) GROUP BY gene) ORDER BY abs(r) DESC, gene LIMIT 10",
    "residualise_within": _fit(fx.RESID) + " SELECT sample, set_name, round(residual, 6) AS residual FROM resid",
    "residual_item_variances": _fit() + """, f AS (SELECT gene, regr_slope(value, axis) AS b, avg(value) AS my, avg(axis) AS mx FROM expr JOIN axis USING (sample) GROUP BY gene)
SELECT gene, round(var_samp(value - (my + b * (axis - mx))), 6) AS variance FROM expr JOIN axis USING (sample) JOIN f USING (gene) GROUP BY gene""",
    "three_way_report": _fit(fx.RESID, _PRED) + f""", g AS (SELECT set_name, corr(score, p) AS r_raw, corr(axis, p) AS r_axis, corr(residual, p) AS r, count(*) AS n FROM resid JOIN p0 USING (sample) GROUP BY ALL)
SELECT set_name, round(r_raw, 6) AS r_raw, round(r_axis, 6) AS r_axis, round(r, 6) AS r_residual, round(atanh(r), 6) AS z_residual, round(tanh(atanh(r) - {_ZN} / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + {_ZN} / sqrt(n - 3)), 6) AS hi, n FROM g""",
    "cronbach_alpha": f"""WITH {fx.EXPR}, {fx.SETS_SQL}, m AS (SELECT set_name, sample, gene, value FROM expr JOIN sets USING (gene)),
c AS (SELECT a.set_name, a.gene AS x, b.gene AS y, corr(a.value, b.value) AS r, count(*) AS n FROM m a JOIN m b ON a.set_name = b.set_name AND a.sample = b.sample AND a.gene < b.gene GROUP BY ALL)
SELECT set_name, CAST(4 AS BIGINT) AS k, max(n) AS n, round(avg(r), 6) AS rho, round(CASE WHEN avg(r) <= 0 THEN 0 ELSE 4 * avg(r) / (1 + 3 * avg(r)) END, 6) AS alpha FROM c GROUP BY set_name""",
    "alpha_from_scores": _fit() + """, g AS (SELECT set_name, CAST(4 AS BIGINT) AS k, count(*) AS n, (16 * sum(score * score) / (count(*) - 1) - 4) / 12 AS rho FROM scores GROUP BY ALL)
SELECT set_name, k, n, round(CASE WHEN rho <= 0 THEN 0 ELSE k * rho / (1 + (k - 1) * rho) END, 6) AS alpha FROM g""",
    "alpha_residual": _fit() + """, fs AS (SELECT set_name, regr_slope(score, axis) AS b, avg(score) AS my, avg(axis) AS mx FROM scores JOIN axis USING (sample) GROUP BY ALL),
v AS (SELECT set_name, var_samp(score - (my + b * (axis - mx))) AS v FROM scores JOIN axis USING (sample) JOIN fs USING (set_name) GROUP BY ALL),
fg AS (SELECT gene, regr_slope(z, axis) AS b, avg(z) AS my, avg(axis) AS mx FROM z JOIN axis USING (sample) GROUP BY gene),
vg AS (SELECT gene, var_samp(z - (my + b * (axis - mx))) AS v FROM z JOIN axis USING (sample) JOIN fg USING (gene) GROUP BY gene),
i AS (SELECT set_name, count(*) AS k, sum(v) AS sv FROM vg JOIN sets USING (gene) GROUP BY ALL)
SELECT set_name, k, round(greatest(0, least(1, k / (k - 1) * (1 - sv / (k * k * v)))), 6) AS alpha FROM i JOIN v USING (set_name)""",
    "split_half": _fit() + """, h AS (SELECT set_name, split, gene, CASE WHEN row_number() OVER (PARTITION BY set_name, split ORDER BY md5('0|' || set_name || '|' || split || '|' || gene), gene) <= 2 THEN 0 ELSE 1 END AS half FROM sets, range(0, 5) AS r(split)),
s AS (SELECT set_name, split, half, sample, avg(z) AS v FROM h JOIN z USING (gene) GROUP BY ALL),
c AS (SELECT a.set_name, a.split, corr(a.v, b.v) AS r FROM s a JOIN s b ON a.set_name = b.set_name AND a.split = b.split AND a.sample = b.sample AND a.half = 0 AND b.half = 1 GROUP BY ALL)
SELECT set_name, round(median(r), 6) AS r_half, round(greatest(0, least(1, 2 * median(r) / (1 + median(r)))), 6) AS reliability FROM c GROUP BY set_name""",
    "tie_audit": f"""WITH {fx.EXPR}, c AS (SELECT sample, round(value, 1) AS v, count(*) AS c FROM expr GROUP BY ALL)
SELECT sample, count(*) FILTER (c > 1) AS n_tied_values, CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS n_tied FROM c GROUP BY sample""",
    "gene_qcut_bins": f"WITH {_BINS} SELECT gene, CAST(bin AS INTEGER) AS bin FROM bins",
    "bin_histogram": f"WITH {_BINS}, {_HIST} SELECT set_name, CAST(bin AS INTEGER) AS bin, want FROM want",
    "random_sets_matched": f"WITH {_BINS}, {_HIST}, {drawn(100)} SELECT set_name, draw, gene FROM drawn",
    "random_sets_size_only": f"WITH bins AS (SELECT p_partkey AS gene, 0 AS bin FROM part), want AS (SELECT p_brand AS set_name, 0 AS bin, count(*) AS want FROM part GROUP BY ALL), {drawn(100)} SELECT set_name, draw, gene FROM drawn",
    "random_sets_short": f"""WITH {_BINS}, want AS (SELECT 'low' || (gene % 2) AS set_name, bin, 3 * count(*) AS want FROM bins WHERE bin < 4 GROUP BY ALL), {drawn(3)},
lack AS (SELECT set_name, sum(want - least(want, have)) AS short, sum(least(want, have)) AS used FROM want JOIN have USING (bin) GROUP BY 1), every AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS p, count(*) OVER () AS total FROM bins),
more AS (SELECT set_name, draw, CAST(short AS BIGINT) AS short, unnest(range(0, CAST(least(short + used, total) AS BIGINT))) AS place, total AS n, {deal_key(0, "draw", str(ALL_BINS), "set_name")} AS key FROM lack, (SELECT count(*) AS total FROM bins), range(0, 3) AS d(draw)), {dealt("more", "spare")},
left_ AS (SELECT set_name, CAST(draw AS INTEGER) AS draw, short, place, gene FROM spare JOIN every ON p = image), rest AS (SELECT *, row_number() OVER (PARTITION BY set_name, draw ORDER BY place) AS r FROM left_ ANTI JOIN drawn USING (set_name, draw, gene))
SELECT set_name, draw, gene FROM drawn UNION ALL SELECT set_name, draw, gene FROM rest WHERE r <= short""",
    "null_percentile": _fit(_NULLS) + " SELECT set_name, round(100.0 * sum((null_r.r < own.r)::INT + (null_r.r <= own.r)::INT) / (2 * count(*)), 6) AS percentile FROM own JOIN null_r USING (set_name) GROUP BY set_name",
    "null_degeneracy": _fit(_NULLS) + f" SELECT set_name, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round(min(r), 6) AS min, round(max(r), 6) AS max, round(max(r) - min(r), 6) AS range, round(stddev_samp({_CLIP.format('r')}), 6) AS z_sd, stddev_samp(r) < 0.02 AS degenerate FROM null_r GROUP BY set_name",
    "excess_over_null": _fit(_NULLS) + f""", o AS (SELECT set_name, n, r / sqrt(0.8) AS r FROM own), q AS (SELECT set_name, r / sqrt(0.6) AS r FROM null_r),
s AS (SELECT set_name, count(*) FILTER (abs(r) < 1) AS n_null, count(*) FILTER (abs(r) >= 1) AS n_dropped, avg({_CLIP.format('r')}) FILTER (abs(r) < 1) AS m, stddev_samp({_CLIP.format('r')}) FILTER (abs(r) < 1) AS sd FROM q GROUP BY set_name),
e AS (SELECT set_name, {_CLIP.format('o.r')} - m AS x, sqrt(1.0 / greatest(n - 3, 1) + sd * sd / n_null) AS se, n_null, n_dropped FROM o JOIN s USING (set_name))
SELECT set_name, round(x, 6) AS excess_z, round(x - {_ZN} * se, 6) AS lo, round(x + {_ZN} * se, 6) AS hi, round(se, 6) AS se, n_null, n_dropped, x - {_ZN} * se > 0 AS beats_null FROM e""",
    "null_summary": _fit(_NULLS) + f""" SELECT set_name, round({_CLIP.format('max(own.r)')} - avg({_CLIP.format('null_r.r')}), 6) AS excess_z, round(avg(null_r.r), 6) AS null_mean, round(stddev_samp(null_r.r), 6) AS null_sd,
round(100.0 * sum((null_r.r < own.r)::INT + (null_r.r <= own.r)::INT) / (2 * count(*)), 6) AS percentile, count(*) AS n_null, stddev_samp(null_r.r) < 0.02 AS null_degenerate FROM own JOIN null_r USING (set_name) GROUP BY set_name""",
    "rotation_null": _fit(_NULLS) + """, f AS (SELECT draw, avg(r) AS m FROM null_r GROUP BY draw), o AS (SELECT avg(r) AS observed FROM own)
SELECT round(max(observed), 6) AS observed, round(avg(m), 6) AS null_mean, round(stddev_samp(m), 6) AS null_sd, round(quantile_cont(m, 0.025), 6) AS null_lo, round(quantile_cont(m, 0.975), 6) AS null_hi, round((1 + count(*) FILTER (m >= observed)) / (1.0 + count(*)), 6) AS p, count(*) AS n_draws FROM f, o""",
    "disattenuation": f"""WITH {fx.EXPR}, {_PRED}, g AS (SELECT gene, corr(value, p) AS r, gene / 64.0 AS rel FROM expr JOIN p0 USING (sample) GROUP BY ALL), x AS (SELECT gene, rel, CASE WHEN rel > 0.01 THEN r / sqrt(rel) END AS c FROM g)
SELECT gene, round(CASE WHEN abs(c) < 1 THEN c END, 6) AS r_corrected, round(4 * rel / (1 + 3 * rel), 6) AS expected FROM x""",
}
