"""The tables of the test data as cohorts, matrices, sets and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The last 16 dimensions of a vector are score genes, 4 to a set; the first 48 are the predictor.
SETS = {f"s{k}": list(range(48 + 4 * k, 52 + 4 * k)) for k in range(4)}

#: The same in SQL, as common table expressions.
EXPR = "expr AS (SELECT vec_id AS sample, label, gene, CAST(value AS DOUBLE) AS value FROM (SELECT vec_id, label, unnest(embedding) AS value, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS gene FROM embeddings))"
SETS_SQL = "sets AS (SELECT 's' || CAST((g - 48) // 4 AS VARCHAR) AS set_name, g AS gene FROM range(48, 64) AS r(g))"
Z = "z AS (SELECT sample, label, gene, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM expr WINDOW w AS (PARTITION BY gene))"
SCORES = "scores AS (SELECT sample, label, set_name, avg(z) AS score FROM z JOIN sets USING (gene) GROUP BY ALL)"
AXIS = "axis AS (SELECT sample, label % 2 AS type, avg(z) AS axis FROM z GROUP BY ALL)"
RESID = """fit AS (SELECT set_name, type, regr_slope(score, axis) AS b, avg(score) AS my, avg(axis) AS mx, count(*) AS n FROM scores JOIN axis USING (sample) GROUP BY ALL),
resid AS (SELECT sample, set_name, type, score, axis, CASE WHEN n >= 5 THEN score - (my + b * (axis - mx)) END AS residual FROM scores JOIN axis USING (sample) JOIN fit USING (set_name, type))"""
MATRIX = f"{EXPR},\n{SETS_SQL},\n{Z},\n{SCORES},\n{AXIS}"
COHORT = "cohort AS (SELECT c_custkey AS patient, c_nationkey AS site, c_mktsegment AS type, c_acctbal AS purity, r_name AS grp FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
#: Two noisy predictions of a price, with the group and stratum of its supplier.
PREDICTED = "pred AS (SELECT l_suppkey AS cluster, l_extendedprice AS y_true, l_quantity AS y_pred, l_discount AS other, r_name AS grp, l_returnflag AS stratum FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
SURVIVAL = "surv AS (SELECT o_orderkey AS sample, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS time, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS event, o_totalprice AS score, o_orderpriority AS stratum FROM orders)"

GROUPS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
REFERENCE = "EUROPE"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def expr(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample"), F.posexplode("embedding")).select("sample", F.col("pos").alias("gene"), F.col("col").cast("double").alias("value"))


def sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, g) for s, genes in SETS.items() for g in genes], "set_name string, gene int")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), "label", (F.col("label") % 2).alias("type"))


def gene(spark: SparkSession, d: str, k: int, name: str) -> DataFrame:
    """One dimension of the predictor."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.get("embedding", F.lit(k)).cast("double").alias(name))


def cohort(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(F.col("c_custkey").alias("patient"), F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("purity"), F.col("r_name").alias("group"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    li, s, n, r = (table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    j = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(F.col("l_suppkey").alias("cluster"), F.col("l_extendedprice").alias("y_true"), F.col("l_quantity").alias("y_pred"), F.col("l_discount").alias("other"), F.col("r_name").alias("group"), F.col("l_returnflag").alias("stratum"))


def survival(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    time = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    return o.select(F.col("o_orderkey").alias("sample"), time.alias("time"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("event"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("stratum"))
