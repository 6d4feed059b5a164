"""The audit's tables in SQL: first components, random sets, residuals, reliabilities, folds, penalties, refits and contrasts."""

from __future__ import annotations

from . import fixtures as fx
from .matrix import _LEADING
from .sqlmath import drawn, gauss_jordan

_ZN = 1.959963984540054
_CLIP = "atanh(greatest(least({0}, 0.999999), -0.999999))"
_DRAWS = 40

#: The cohort, its genes and sets; the first component of each type by squaring.
_COHORT = f"""{fx.EXPR}, f AS MATERIALIZED (SELECT vec_id AS key, 'S' || (vec_id % 20) AS site, CAST(label % 2 AS VARCHAR) AS type, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
feat AS (SELECT key, unnest([1, 2, 3, 4]) AS i, unnest([a, b, b, a * b]) AS v FROM f), ge AS MATERIALIZED (SELECT o.sample, o.gene, o.value + 1.5 * s.value AS value FROM expr o JOIN expr s ON s.sample = o.sample AND s.gene = o.gene % 8 WHERE o.gene >= 8),
sets AS (SELECT 's' || (g % 8) AS set_name, g AS gene FROM range(8, 64) AS r(g) WHERE g % 8 < 4),
x AS (SELECT ge.sample, type AS grp, gene, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM ge JOIN f ON key = ge.sample WINDOW w AS (PARTITION BY type, gene))"""

#: Scores of sets and of their random sets, what the axis leaves of them within types, and their reliabilities.
_RESIDUALS = f"""axis AS MATERIALIZED (SELECT sample, x.grp AS type, sum(z * v) AS axis FROM x JOIN vec USING (grp, gene) GROUP BY ALL),
zz AS MATERIALIZED (SELECT sample, gene, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM ge WINDOW w AS (PARTITION BY gene)),
bins AS (SELECT gene, greatest(CAST(ceil((r - 1) * 10.0 / (n - 1)) AS BIGINT) - 1, 0) AS bin FROM (SELECT gene, row_number() OVER (ORDER BY level, gene) AS r, count(*) OVER () AS n FROM (SELECT gene, avg(value) AS level FROM ge GROUP BY 1))),
want AS (SELECT set_name, bin, count(*) AS want FROM sets JOIN bins USING (gene) GROUP BY ALL), {drawn(_DRAWS)},
members AS MATERIALIZED (SELECT set_name, -1 AS draw, gene FROM sets UNION ALL SELECT set_name, draw, gene FROM drawn), sc AS MATERIALIZED (SELECT sample, set_name, draw, avg(z) AS score FROM members JOIN zz USING (gene) GROUP BY ALL),
line AS (SELECT set_name, draw, type, regr_slope(score, axis) AS b, avg(score) AS my, avg(axis) AS mx FROM sc JOIN axis USING (sample) GROUP BY ALL),
res AS MATERIALIZED (SELECT sample AS key, set_name, draw, score - (my + b * (axis - mx)) AS y FROM sc JOIN axis USING (sample) JOIN line USING (set_name, draw, type)),
gl AS (SELECT gene, type, regr_slope(z, axis) AS b, avg(z) AS my, avg(axis) AS mx FROM zz JOIN axis USING (sample) GROUP BY ALL), gv AS (SELECT gene, var_samp(z - (my + b * (axis - mx))) AS v FROM zz JOIN axis USING (sample) JOIN gl USING (gene, type) GROUP BY 1),
rel AS (SELECT set_name, draw, greatest(0, least(1, k / (k - 1) * (1 - sv / (k * k * v)))) AS rel FROM (SELECT set_name, draw, count(*)::DOUBLE AS k, sum(v) AS sv FROM members JOIN gv USING (gene) GROUP BY ALL) JOIN (SELECT set_name, draw, var_samp(y) AS v FROM res GROUP BY ALL) USING (set_name, draw))"""

#: Patients dealt by a hash, and whole sites dealt to the least fold, the largest first.
_FOLDS = """t AS (SELECT site, count(*)::DOUBLE AS n, md5('0|' || site) AS lot FROM f GROUP BY 1), o AS (SELECT site, n, share, row_number() OVER (ORDER BY n DESC, lot) AS p FROM t, (SELECT sum(n) / 5 AS share FROM t)),
d(p, site, f, size) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::INTEGER, [0, 0, 0, 0, 0]::DOUBLE[] UNION ALL SELECT p, site, f, list_transform(range(1, 6), lambda i: size[i] + CASE WHEN i = f + 1 THEN n ELSE 0 END) FROM (
SELECT o.p, o.site, o.n, size, list_sort(list_transform(range(1, 6), lambda i: {'c': round(((size[i] + n) * (size[i] + n) - size[i] * size[i]) / (share * share), 9), 'h': md5('0|' || o.site || '|' || (i - 1)), 'f': CAST(i - 1 AS INTEGER)}))[1].f AS f FROM d JOIN o ON o.p = d.p + 1)),
folds AS MATERIALIZED (SELECT 'random_patient' AS scheme, key, CAST((row_number() OVER (ORDER BY md5('0|' || key), key) - 1) % 5 AS INTEGER) AS fold FROM f UNION ALL SELECT 'preserved_site', key, d.f FROM f JOIN d USING (site))"""

#: Ridge by fold and penalty; penalties with the least leave-one-out error of predictions (p) and of residuals (r).
_RIDGE = f"""ks AS (SELECT unnest(range(0, 5)) AS k), st AS (SELECT scheme, k, i, avg(v) AS m, stddev_pop(v) AS s FROM folds JOIN feat USING (key), ks WHERE fold <> k GROUP BY ALL),
xs AS MATERIALIZED (SELECT scheme, k, key, fold, i, (v - m) / s AS x FROM folds JOIN feat USING (key) JOIN st USING (scheme, i)),
gr AS MATERIALIZED (SELECT p.scheme, p.k, p.i, q.i AS j, sum(p.x * q.x) AS v FROM xs p JOIN xs q ON p.scheme = q.scheme AND p.k = q.k AND p.key = q.key WHERE p.fold <> p.k GROUP BY ALL),
al AS (SELECT q, pow(10.0, -2 + 7.0 * q / 23) AS alpha FROM range(0, 24) AS r(q)), sys AS (SELECT scheme, k, q, i, j, v + CASE WHEN i = j THEN alpha ELSE 0 END AS v FROM gr, al UNION ALL SELECT scheme, k, q, i, 4 + j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM gr, al),
{gauss_jordan("sys", ["scheme", "k", "q"], 4, "inv")},
tasks AS MATERIALIZED (SELECT scheme, 'p' AS kind, set_name, sample AS key, score AS y FROM sc, (SELECT unnest(['random_patient', 'preserved_site']) AS scheme) WHERE draw = -1 UNION ALL SELECT 'preserved_site', 'r', set_name, key, y FROM res WHERE draw = -1),
my AS MATERIALIZED (SELECT scheme, kind, set_name, k, avg(y) AS ybar, count(*) AS n FROM tasks JOIN folds USING (scheme, key), ks WHERE fold <> k GROUP BY ALL),
rhs AS MATERIALIZED (SELECT scheme, kind, set_name, k, i, sum(x * (y - ybar)) AS v FROM xs JOIN tasks USING (scheme, key) JOIN my USING (scheme, kind, set_name, k) WHERE fold <> k GROUP BY ALL),
beta AS MATERIALIZED (SELECT inv.scheme, kind, set_name, inv.k, q, inv.i, sum(inv.v * rhs.v) AS b FROM inv JOIN rhs ON rhs.scheme = inv.scheme AND rhs.k = inv.k AND rhs.i = inv.j - 4 GROUP BY ALL),
h AS MATERIALIZED (SELECT p.scheme, p.k, q, p.key, sum(p.x * inv.v * w.x) AS h FROM xs p JOIN inv ON inv.scheme = p.scheme AND inv.k = p.k AND inv.i = p.i JOIN xs w ON w.scheme = p.scheme AND w.k = p.k AND w.key = p.key AND w.i = inv.j - 4 WHERE p.fold <> p.k GROUP BY ALL),
fitted AS (SELECT xs.scheme, kind, set_name, xs.k, q, key, sum(x * b) AS p FROM xs JOIN beta USING (scheme, k, i) WHERE fold <> xs.k GROUP BY ALL),
loo AS (SELECT scheme, kind, set_name, k, q, avg(pow((y - ybar - p) / (1 - 1.0 / n - h), 2)) AS mse FROM fitted JOIN h USING (scheme, k, q, key) JOIN tasks USING (scheme, kind, set_name, key) JOIN my USING (scheme, kind, set_name, k) GROUP BY ALL),
best AS MATERIALIZED (SELECT scheme, kind, set_name, k, q FROM (SELECT *, row_number() OVER (PARTITION BY scheme, kind, set_name, k ORDER BY mse, q) AS place FROM loo) WHERE place = 1)"""

_AUDIT = f"WITH RECURSIVE {_LEADING.removeprefix('WITH ').format(long=_COHORT)},\n{_RESIDUALS},\n{_FOLDS},\n{_RIDGE}"

ORACLE_SQL = {
    "audit_immune_excess": f"""{_AUDIT},
ma AS (SELECT set_name, draw, k, avg(y) AS ybar FROM res JOIN folds USING (key), ks WHERE scheme = 'preserved_site' AND fold <> k GROUP BY ALL),
ra AS MATERIALIZED (SELECT set_name, draw, k, i, sum(x * (y - ybar)) AS v FROM xs JOIN res USING (key) JOIN ma USING (set_name, draw, k) WHERE scheme = 'preserved_site' AND fold <> k GROUP BY ALL),
ba AS MATERIALIZED (SELECT ra.set_name, draw, ra.k, inv.i, sum(inv.v * ra.v) AS b FROM ra JOIN best ON best.scheme = 'preserved_site' AND kind = 'r' AND best.set_name = ra.set_name AND best.k = ra.k JOIN inv ON inv.scheme = 'preserved_site' AND inv.k = ra.k AND inv.q = best.q AND inv.j - 4 = ra.i GROUP BY ALL),
pa AS (SELECT set_name, draw, key, max(ybar) + sum(x * b) AS p FROM xs JOIN ba USING (k, i) JOIN ma USING (set_name, draw, k) WHERE scheme = 'preserved_site' AND fold = k GROUP BY ALL),
r AS (SELECT set_name, draw, corr(y, p) AS r, count(*) AS n FROM pa JOIN res USING (set_name, draw, key) GROUP BY ALL),
c AS (SELECT set_name, draw, r, n, rel, CASE WHEN rel > 0.01 AND abs(r) < sqrt(greatest(rel, 0.01)) THEN r / sqrt(rel) END AS c FROM r JOIN rel USING (set_name, draw)),
nul AS (SELECT set_name, count(c) AS n_null, count(r) - count(c) AS n_dropped, avg({_CLIP.format('c')}) FILTER (c IS NOT NULL) AS m, stddev_samp({_CLIP.format('c')}) FILTER (c IS NOT NULL) AS sd, avg(rel) AS alpha_null_mean, stddev_samp(r) < 0.02 AS degenerate FROM c WHERE draw >= 0 GROUP BY 1),
e AS (SELECT c.*, nul.* EXCLUDE (set_name), CASE WHEN n_null >= 5 AND c IS NOT NULL THEN {_CLIP.format('c')} - m END AS x, CASE WHEN n_null >= 5 AND c IS NOT NULL THEN sqrt(1.0 / greatest(n - 3, 1) + sd * sd / n_null) END AS se FROM c JOIN nul USING (set_name) WHERE draw = -1)
SELECT set_name, n, n_null, n_dropped, round(r, 5) AS r_residual_refit, round(rel, 5) AS alpha_observed, round(alpha_null_mean, 5) AS alpha_null_mean, round(x, 5) AS excess_z, round(x - {_ZN} * se, 5) AS lo, round(x + {_ZN} * se, 5) AS hi, coalesce(x - {_ZN} * se > 0, false) AS beats_null, degenerate FROM e""",
    "audit_per_signature": f"""{_AUDIT},
pr AS (SELECT xs.scheme, b.set_name, key, max(ybar) + sum(x * b) AS p FROM xs JOIN best USING (scheme, k) JOIN beta b ON b.scheme = xs.scheme AND b.kind = 'p' AND b.set_name = best.set_name AND b.k = xs.k AND b.q = best.q AND b.i = xs.i JOIN my ON my.scheme = xs.scheme AND my.kind = 'p' AND my.set_name = b.set_name AND my.k = xs.k WHERE best.kind = 'p' AND fold = xs.k GROUP BY ALL),
r AS (SELECT scheme, set_name, corr(y, p) AS r, count(*) AS n FROM pr JOIN tasks USING (scheme, set_name, key) WHERE kind = 'p' GROUP BY ALL),
l AS (SELECT set_name, site, type, a AS other, fold, score AS y FROM sc JOIN f ON key = sample JOIN folds USING (key) WHERE draw = -1 AND scheme = 'random_patient'),
w AS (SELECT *, sum(y) OVER g - sum(y) OVER gf AS s1, count(*) OVER g - count(*) OVER gf AS n1, sum(y) OVER t - sum(y) OVER tf AS s2, count(*) OVER t - count(*) OVER tf AS n2, sum(y) OVER w - sum(y) OVER wf AS s3, count(*) OVER w - count(*) OVER wf AS n3, sum(other) OVER w - sum(other) OVER wf AS sx, sum(other * other) OVER w - sum(other * other) OVER wf AS sxx, sum(other * y) OVER w - sum(other * y) OVER wf AS sxy FROM l
WINDOW g AS (PARTITION BY set_name, site), gf AS (PARTITION BY set_name, site, fold), t AS (PARTITION BY set_name, type), tf AS (PARTITION BY set_name, type, fold), w AS (PARTITION BY set_name), wf AS (PARTITION BY set_name, fold)),
b3 AS (SELECT set_name, y, CASE WHEN n1 > 0 THEN s1 / n1 ELSE s3 / n3 END AS b1, CASE WHEN n2 > 0 THEN s2 / n2 ELSE s3 / n3 END AS b2, s3 / n3 + (sxy - sx * s3 / n3) / (sxx - sx * sx / n3) * (other - sx / n3) AS b3 FROM w),
bl AS (SELECT set_name, corr(y, b1) AS c1, corr(y, b2) AS c2, corr(y, b3) AS c3 FROM b3 GROUP BY 1)
SELECT set_name AS signature, u.n, round(u.r, 5) AS r_random_patient, round(v.r, 5) AS r_preserved_site, round({_CLIP.format('u.r')} - {_CLIP.format('v.r')}, 5) AS delta_z, round(c1, 5) AS r_site_only, round(c2, 5) AS r_type_only, round(c3, 5) AS r_purity_only
FROM (SELECT * FROM r WHERE scheme = 'random_patient') u JOIN (SELECT * FROM r WHERE scheme = 'preserved_site') v USING (set_name) JOIN bl USING (set_name)""",
}
