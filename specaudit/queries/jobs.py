"""The jobs as queries: each runs twice into one new folder and returns the whole output as it stands then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from . import fixtures as fx
from .sqlmath import drawn

SET_AUDIT = {"type": "label % 2", "sets": fx.SETS}
_ROUNDED = ("mean", "sd", "gap", "site_share")


def _six(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def job1_site_monitor(spark: SparkSession, d: str) -> DataFrame:
    from jobs import site_monitor

    base = shared_folder(spark, "site-monitor")
    for _ in range(2):
        out = site_monitor.run(spark, f"{d}/documents.parquet", f"{base}/out", f"{base}/checkpoint")
    return _six(out, _ROUNDED)


def job2_set_audit(spark: SparkSession, d: str) -> DataFrame:
    from jobs import set_audit

    base = shared_folder(spark, "set-audit")
    for _ in range(2):
        out = set_audit.run(spark, f"{d}/embeddings.parquet", f"{base}/out", SET_AUDIT)
    return _six(out, [c for c, kind in out.dtypes if kind == "double"])


QUERIES = {f.__name__: f for f in (job1_site_monitor, job2_set_audit)}

_SPACE = r"[^ \t\n\x0B\f\r]"
_ZN = 1.959963984540054

ORACLE_SQL = {
    "job1_site_monitor": f"""WITH d AS (SELECT source AS site, lang AS type, doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT site, type, doc_id, length(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS n_nonspace, len(regexp_extract_all(t, '{_SPACE}+')) AS n_words, len(regexp_extract_all(t, '[^\\n]+')) AS n_lines,
  len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[0-9]')) AS n_digits FROM d),
l AS (SELECT site, type, doc_id IS NOT NULL AND n_words >= 1 AS kept, unnest(['n_nonspace', 'n_words', 'n_lines', 'n_upper', 'n_digits']) AS feature, CAST(unnest([n_nonspace, n_words, n_lines, n_upper, n_digits]) AS BIGINT) AS v FROM f),
g AS (SELECT feature, type, site, count(*) AS n_rows, count(*) FILTER (kept) AS n, coalesce(sum(CAST(v AS HUGEINT)) FILTER (kept), 0) AS t, coalesce(sum(CAST(v AS HUGEINT) * v) FILTER (kept), 0) AS q, min(v) FILTER (kept) AS low, max(v) FILTER (kept) AS high FROM l GROUP BY ALL),
w AS (SELECT *, sum(n) OVER k AS nn, sum(t) OVER k AS tt, sum(q) OVER k AS qq, sum(CASE WHEN n > 0 THEN CAST(t AS DOUBLE) * t / n ELSE 0 END) OVER k AS b FROM g WINDOW k AS (PARTITION BY feature, type)),
x AS (SELECT *, CAST(n * q - t * t AS DOUBLE) AS own, CAST(nn * qq - tt * tt AS DOUBLE) AS alls, CAST(nn AS DOUBLE) AS bn, CAST(tt AS DOUBLE) AS bt FROM w)
SELECT type, site, n_rows, n, round(CAST(t AS DOUBLE) / nullif(n, 0), 6) AS mean, round(sqrt(own / nullif(CAST(n AS DOUBLE) * (n - 1), 0)), 6) AS sd, low, high,
  round((CAST(t AS DOUBLE) / nullif(n, 0) - (bt - t) / nullif(bn - n, 0)) / nullif(sqrt(alls / nullif(bn * (bn - 1), 0)), 0), 6) AS gap, round((b * bn - bt * bt) / nullif(alls, 0), 6) AS site_share, feature FROM x""",
    "job2_set_audit": f"""WITH {fx.MATRIX}, {fx.RESID},
p AS (SELECT sample, value AS p FROM expr WHERE gene = 0),
level AS (SELECT gene, avg(value) AS level FROM expr WHERE gene <> 0 GROUP BY gene),
bins AS (SELECT gene, greatest(CAST(ceil((r - 1) * 10.0 / (n - 1)) AS BIGINT) - 1, 0) AS bin FROM (SELECT gene, row_number() OVER (ORDER BY level, gene) AS r, count(*) OVER () AS n FROM level)),
want AS (SELECT set_name, bin, count(*) AS want FROM sets JOIN bins USING (gene) GROUP BY ALL),
{drawn(20)},
ns AS (SELECT sample, set_name, draw, label % 2 AS type, avg(z) AS score FROM drawn JOIN z USING (gene) GROUP BY ALL),
nf AS (SELECT set_name, draw, type, regr_slope(score, axis) AS b, avg(score) AS my, avg(axis) AS mx, count(*) AS n FROM ns JOIN axis USING (sample, type) GROUP BY ALL),
nr AS (SELECT set_name, draw, corr(score - (my + b * (axis - mx)), p) AS r FROM ns JOIN axis USING (sample, type) JOIN nf USING (set_name, draw, type) JOIN p USING (sample) GROUP BY ALL),
own AS (SELECT set_name, corr(score, p) AS r_raw, corr(axis, p) AS r_axis, corr(residual, p) AS r, count(residual) AS n FROM resid JOIN p USING (sample) GROUP BY ALL),
m AS (SELECT set_name, sample, gene, value FROM expr JOIN sets USING (gene)),
c AS (SELECT a.set_name, avg(r) AS rho FROM (SELECT a.set_name, a.gene, b.gene, corr(a.value, b.value) AS r FROM m a JOIN m b ON a.set_name = b.set_name AND a.sample = b.sample AND a.gene < b.gene GROUP BY ALL) a GROUP BY a.set_name),
e AS (SELECT set_name, atanh(max(own.r)) - avg(atanh(nr.r)) AS excess, sqrt(1.0 / (max(own.n) - 3) + var_samp(atanh(nr.r)) / count(nr.r)) AS se, count(nr.r) AS n_null FROM own JOIN nr USING (set_name) GROUP BY set_name)
SELECT sample, type, round(score, 6) AS score, round(axis, 6) AS axis, round(residual, 6) AS residual, set_name, own.n, round(r_raw, 6) AS r_raw, round(r_axis, 6) AS r_axis, round(r, 6) AS r_residual,
  round(tanh(atanh(r) - {_ZN} / sqrt(own.n - 3)), 6) AS r_low, round(tanh(atanh(r) + {_ZN} / sqrt(own.n - 3)), 6) AS r_high, CAST(4 AS BIGINT) AS n_genes, round(CASE WHEN rho <= 0 THEN 0 ELSE 4 * rho / (1 + 3 * rho) END, 6) AS reliability,
  round(excess, 6) AS excess_z, round(excess - {_ZN} * se, 6) AS lo, round(excess + {_ZN} * se, 6) AS hi, round(se, 6) AS se, n_null, CAST(0 AS BIGINT) AS n_dropped, excess - {_ZN} * se > 0 AS beats_null
FROM resid JOIN own USING (set_name) JOIN c USING (set_name) JOIN e USING (set_name)""",
}
