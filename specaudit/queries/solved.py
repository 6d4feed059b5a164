"""SQL of the queries whose values solve equations: hazards, logistic and ridge models, least squares with factors."""

from __future__ import annotations

from . import fixtures as fx
from .sqlmath import cox, gauss_jordan, logistic_pair, upper_tail

_ZN = 1.959963984540054
_C_INDEX = "SELECT avg(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0.0 END) AS c_index FROM {0} a JOIN {0} b ON b.time > a.time WHERE a.event = 1"


def _type_hazard(steps: int = 40) -> str:
    """Coordinate-wise, damped Newton steps on dummies of types, the first left out."""
    out = ["cells AS (SELECT stratum AS g, time, count(*) AS n, sum(event) AS d FROM surv WHERE time > 0 AND stratum IS NOT NULL GROUP BY ALL)", "ref AS (SELECT min(g) AS r FROM cells)", "grid AS MATERIALIZED (SELECT t.time, l.g, coalesce(n, 0) AS n, coalesce(d, 0) AS d FROM (SELECT DISTINCT time FROM cells) t CROSS JOIN (SELECT DISTINCT g FROM cells) l LEFT JOIN cells c ON c.time = t.time AND c.g = l.g)", "b0 AS (SELECT DISTINCT g, 0.0::DOUBLE AS b FROM cells)"]
    for t in range(steps):
        out.append(f"r{t} AS (SELECT time, g, d, sum(n * exp(b)) OVER (PARTITION BY g ORDER BY time DESC) AS s FROM grid JOIN b{t} USING (g))")
        out.append(f"a{t} AS (SELECT g, d, sum(d) OVER (PARTITION BY time) AS dd, s / sum(s) OVER (PARTITION BY time) AS share FROM r{t})")
        out.append(f"b{t + 1} AS MATERIALIZED (SELECT g, CASE WHEN g = max(r) THEN 0 ELSE max(b) + 0.8 * (sum(d) - sum(dd * share)) / sum(dd * share * (1 - share)) END AS b FROM a{t} JOIN b{t} USING (g), ref GROUP BY g)")
    return ",\n".join(out) + f",\nv AS (SELECT time, event, b AS score FROM surv JOIN b{steps} ON g = stratum WHERE time > 0)"


#: Vectors as rows of 48 features and 16 targets, a fifth of them in each fold, and the features scaled by a fold's other rows.
_RIDGE = f"""{fx.EXPR}, e AS MATERIALIZED (SELECT sample AS key, sample % 5 AS fold, gene, value FROM expr), ks AS (SELECT unnest(range(0, 5)) AS k),
st AS (SELECT k, gene, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM e, ks WHERE fold <> k GROUP BY ALL),
xs AS MATERIALIZED (SELECT k, key, fold, gene + 1 AS i, (value - m) / s AS x FROM e JOIN st USING (gene) WHERE gene < 48),
ys AS MATERIALIZED (SELECT k, key, fold, gene + 1 AS j, value - m AS y, value, m FROM e JOIN st USING (gene) WHERE gene >= 48),
g AS MATERIALIZED (SELECT a.k, a.i, b.i AS j, sum(a.x * b.x) AS v FROM xs a JOIN xs b ON a.k = b.k AND a.key = b.key WHERE a.fold <> a.k GROUP BY ALL),
rhs AS MATERIALIZED (SELECT a.k, a.i, b.j, sum(a.x * b.y) AS v FROM xs a JOIN ys b ON a.k = b.k AND a.key = b.key WHERE a.fold <> a.k GROUP BY ALL)"""

#: Leave-one-out errors of the first target at each penalty: residuals over 1 - h, h from the inverse.
_LOO = f"""{_RIDGE}, al AS (SELECT q, pow(10.0, -2 + 7.0 * q / 23) AS alpha FROM range(0, 24) AS r(q)),
sys AS (SELECT k, q, i, j, v + CASE WHEN i = j THEN alpha ELSE 0 END AS v FROM g, al UNION ALL SELECT k, q, i, 49, v FROM rhs, al WHERE j = 49 UNION ALL SELECT k, q, i, 49 + j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM g, al),
{gauss_jordan("sys", ["k", "q"], 48, "sol")},
fitted AS (SELECT xs.k, q, key, sum(x * v) AS p FROM xs JOIN sol USING (k, i) WHERE sol.j = 49 AND fold <> xs.k GROUP BY ALL),
lever AS (SELECT xs.k, q, key, sol.j - 49 AS i, sum(x * v) AS u FROM xs JOIN sol USING (k, i) WHERE sol.j > 49 AND fold <> xs.k GROUP BY ALL),
h AS (SELECT k, q, key, sum(u * x) AS h FROM lever JOIN xs USING (k, key, i) GROUP BY ALL),
nk AS (SELECT k, max(n) AS n FROM st GROUP BY k),
loo AS (SELECT k, q, avg(pow((y - p) / (1 - 1.0 / n - h), 2)) AS mse FROM fitted JOIN h USING (k, q, key) JOIN ys USING (k, key) JOIN nk USING (k) WHERE j = 49 GROUP BY ALL),
place AS (SELECT k, alpha, mse, row_number() OVER (PARTITION BY k ORDER BY mse, q) AS place FROM loo JOIN al USING (q))"""


def _ladder(n: int, models: str, columns: str) -> str:
    """CTEs of least squares of nested models on one table: columns gives ``cols`` (row, i, v), i up to n, and ``target`` (row, y); models gives
    model and i. A column that a model lacks is a row of the identity in its system."""
    return f"""{columns},
mu AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM cols GROUP BY i), sd AS MATERIALIZED (SELECT row, i, (v - m) / s AS x FROM cols JOIN mu USING (i) WHERE s > 1e-9),
yc AS MATERIALIZED (SELECT row, y - avg(y) OVER () AS y FROM target), tot AS (SELECT count(*) AS n, sum(y * y) AS total FROM yc),
xx AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM sd a JOIN sd b USING (row) GROUP BY ALL), xy AS MATERIALIZED (SELECT i, sum(x * y) AS v FROM sd JOIN yc USING (row) GROUP BY i),
has AS MATERIALIZED ({models}), used AS MATERIALIZED (SELECT model, i FROM has WHERE i IN (SELECT i FROM xy)), names AS (SELECT DISTINCT model FROM has),
sys AS MATERIALIZED (SELECT model, a.i, b.j, CASE WHEN xx.v IS NOT NULL THEN xx.v WHEN a.i = b.j THEN 1.0 ELSE 0.0 END AS v FROM names CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS i) a CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS j) b
  LEFT JOIN (SELECT u.model, xx.* FROM xx JOIN used u ON u.i = xx.i JOIN used w ON w.i = xx.j AND w.model = u.model) xx USING (model, i, j)
  UNION ALL SELECT model, i, {n + 1}, coalesce(xy.v, 0.0) FROM names CROSS JOIN (SELECT unnest(range(1, {n + 1})) AS i) a LEFT JOIN (SELECT model, i, xy.v FROM used JOIN xy USING (i)) xy USING (model, i)),
{gauss_jordan("sys", ["model"], n, "sol")},
r2 AS (SELECT names.model, greatest(0, least(1, coalesce(sum(sol.v * xy.v) / max(total), 0))) AS r2, max(n) AS n, count(xy.v) + 1 AS p FROM names CROSS JOIN tot LEFT JOIN used USING (model) LEFT JOIN sol USING (model, i) LEFT JOIN xy USING (i) GROUP BY names.model),
adj AS (SELECT model, r2, n, p, 1 - (1 - r2) * (n - 1) / (n - p) AS adj FROM r2)"""


#: Columns: purity, the prediction, four types and 24 sites, each but the first of its kind.
_COHORT_COLUMNS = f"""{fx.COHORT}, f AS (SELECT row_number() OVER () AS row, * FROM cohort),
ty AS (SELECT type, row_number() OVER (ORDER BY type) AS r FROM (SELECT DISTINCT type FROM f)), si AS (SELECT site, row_number() OVER (ORDER BY CAST(site AS VARCHAR)) AS r FROM (SELECT DISTINCT site FROM f)),
cols AS MATERIALIZED (SELECT row, 1 AS i, purity AS v FROM f UNION ALL SELECT row, 2, CAST(patient % 101 + site AS DOUBLE) FROM f UNION ALL SELECT row, 1 + r, CASE WHEN f.type = ty.type THEN 1.0 ELSE 0.0 END FROM f CROSS JOIN ty WHERE r > 1 UNION ALL SELECT row, 5 + r, CASE WHEN f.site = si.site THEN 1.0 ELSE 0.0 END FROM f CROSS JOIN si WHERE r > 1)"""
_LADDER_MODELS = """SELECT 'M0' AS model, 0 AS i UNION ALL SELECT m, i FROM (SELECT unnest(['M1_purity', 'M2_type', 'M3_site', 'Mfull']) AS m) CROSS JOIN (SELECT unnest(range(1, 31)) AS i)
  WHERE i = 1 OR (i = 2 AND m = 'Mfull') OR (i BETWEEN 3 AND 6 AND m <> 'M1_purity') OR (i > 6 AND m IN ('M3_site', 'Mfull')) UNION ALL SELECT 'Image_only', 2"""

ORACLE_SQL = {
    "cox_score": f"""WITH {fx.SURVIVAL}, v AS (SELECT 1 AS k, time, event, score, (score - avg(score) OVER ()) / stddev_pop(score) OVER () AS x FROM surv WHERE time > 0), {cox("v", ["k"], "fit")},
c AS ({_C_INDEX.format("v")}), z AS (SELECT b, info, abs(b) * sqrt(info) AS z FROM fit)
SELECT round(exp(b), 6) AS hr, round(b, 6) AS coef, round(1 / sqrt(info), 6) AS se, round(2 * {upper_tail("z")}, 6) AS p, (SELECT round(c_index, 6) FROM c) AS c_index, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM v WHERE event = 1) AS n_events FROM z""",
    "type_hazard_concordance": f"WITH {fx.SURVIVAL}, {_type_hazard()}, c AS ({_C_INDEX.format('v')}) SELECT round(c_index, 8) AS c_index, (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM v WHERE event = 1) AS n_events FROM c",
    "outcome_arm_coef": f"""WITH {fx.SURVIVAL}, s AS (SELECT -1 AS draw, time, event, score FROM surv WHERE time > 0 UNION ALL SELECT draw, time, event, CAST(CAST('0x' || substr(md5('0|' || draw || '|' || sample), 1, 8) AS BIGINT) AS DOUBLE) FROM surv, range(0, 10) AS r(draw) WHERE time > 0),
v AS (SELECT draw, time, event, (score - avg(score) OVER w) / stddev_pop(score) OVER w AS x FROM s WINDOW w AS (PARTITION BY draw)), {cox("v", ["draw"], "fit")},
o AS (SELECT b, (SELECT count(*) FROM v WHERE draw = -1) AS n, (SELECT count(*) FROM v WHERE draw = -1 AND event = 1) AS n_events FROM fit WHERE draw = -1), q AS (SELECT avg(abs(b)) AS m, stddev_samp(abs(b)) AS sd, count(*) AS n_null FROM fit WHERE draw >= 0)
SELECT 'price' AS set_name, 'raw' AS adjustment, 'coef' AS metric, n_events, n_null, round(b, 5) AS observed, round(abs(b) - m, 5) AS excess_z, abs(b) - m - {_ZN} * sqrt(1.0 / (n - 3) + sd * sd / n_null) > 0 AS beats_null FROM o, q""",
    "site_logistic_pair": f"""WITH e AS (SELECT vec_id % 5 AS fold, label AS site, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), big AS (SELECT site AS target FROM e GROUP BY 1 HAVING count(*) >= 20), ks AS (SELECT unnest(range(0, 5)) AS k),
st AS (SELECT k, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM e, ks WHERE fold <> k GROUP BY k),
x AS (SELECT target * 5 + k AS m, target, k, fold, CASE WHEN site = target THEN 1.0 ELSE 0.0 END AS y, (a - ma) / sa AS x1, (b - mb) / sb AS x2 FROM e, big, st), t AS MATERIALIZED (SELECT m, y, x1, x2 FROM x WHERE fold <> k), {logistic_pair("t", "fit")},
s AS (SELECT target AS site, y, w0 + w1 * x1 + w2 * x2 AS s FROM x JOIN fit USING (m) WHERE fold = k), r AS (SELECT site, y, rank() OVER (PARTITION BY site ORDER BY s) + (count(*) OVER (PARTITION BY site, s) - 1) / 2.0 AS r FROM s)
SELECT site, CAST(sum(y) AS BIGINT) AS n_patients, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM r GROUP BY 1""",
    "ridge_oof": f"""WITH {_RIDGE}, sys AS (SELECT k, i, j, v + CASE WHEN i = j THEN 10.0 ELSE 0 END AS v FROM g UNION ALL SELECT * FROM rhs), {gauss_jordan("sys", ["k"], 48, "sol")},
p AS (SELECT key, xs.k, sol.j, sum(x * v) AS p FROM xs JOIN sol USING (k, i) WHERE fold = xs.k GROUP BY ALL)
SELECT key, CAST(k AS INTEGER) AS fold, 'g' || (j - 1) AS target, round(value, 6) AS y_true, round(p + m, 6) AS y_pred FROM p JOIN ys USING (k, key, j)""",
    "ridge_loo_alpha": f"WITH {_LOO} SELECT k AS fold, round(alpha, 8) AS alpha FROM place WHERE place = 1",
    "penalty_margin": f'WITH {_LOO} SELECT k AS fold, max(round(alpha, 8)) FILTER (place = 1) AS "first", max(round(alpha, 8)) FILTER (place = 2) AS second, round(max(mse) FILTER (place = 2) / max(mse) FILTER (place = 1) - 1, 8) AS gap FROM place GROUP BY k',
    "r2_ladder": f"""WITH {_ladder(30, _LADDER_MODELS, _COHORT_COLUMNS + ", target AS (SELECT row, purity + site * 10 AS y FROM f)")},
o AS (SELECT *, CASE model WHEN 'M0' THEN 0 WHEN 'M1_purity' THEN 1 WHEN 'M2_type' THEN 2 WHEN 'M3_site' THEN 3 WHEN 'Mfull' THEN 4 ELSE 5 END AS place FROM adj)
SELECT model, CAST(n AS BIGINT) AS n, round(r2, 6) AS r2, round(adj, 6) AS adj_r2, CASE WHEN place < 5 THEN round(r2 - lag(r2, 1, 0) OVER (ORDER BY place), 6) END AS delta_r2 FROM o""",
    "label_site_variance": f"""WITH {_ladder(30, "SELECT unnest(['site', 'type', 'both']) AS model, 0 AS i UNION ALL SELECT m, i FROM (SELECT unnest(['site', 'type', 'both']) AS m) CROSS JOIN (SELECT unnest(range(3, 31)) AS i) WHERE (i > 6 AND m <> 'type') OR (i <= 6 AND m <> 'site')", _COHORT_COLUMNS + ", target AS (SELECT row, purity AS y FROM f)")}
SELECT 'purity' AS signature, CAST(max(n) AS BIGINT) AS n, (SELECT count(DISTINCT site) FROM f) AS n_sites, round(max(r2) FILTER (model = 'site'), 6) AS r2_site_only, round(max(adj) FILTER (model = 'site'), 6) AS adj_r2_site_only,
  round(max(r2) FILTER (model = 'type'), 6) AS r2_type_only, round(max(r2) FILTER (model = 'both') - max(r2) FILTER (model = 'type'), 6) AS r2_site_given_type FROM adj""",
}
