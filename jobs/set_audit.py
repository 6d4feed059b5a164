"""Batch job: does a predictor see something specific to named feature sets, or only what random sets of the same size and level show?

    python jobs/set_audit.py --matrix PATH --output DIR --config FILE [--only SET ...]

Reads a table of vectors (a sample's features), scores each named set and so many random sets matched by level, takes
out the common axis within types, and contrasts the predictor's correlation with each set's residual with
those of its random sets. It writes

* ``output/scores/set_name=S``: ``sample, type, score, axis, residual``,
* ``output/report/set_name=S``: one row, the correlations with interval, the reliability, the excess over the null.

With ``--only`` other sets' partitions stay as they are. A rerun overwrites a set's partitions with the same rows: draws are
hash orders and nothing depends on the order of rows.

Samples whose vector is missing a number go without that number; those without the predictor have scores, but enter no
correlation. Null samples and types are left out.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from specaudit.functions.stats import corr_interval, pearson  # noqa: E402
from specaudit.operators import axis as axes  # noqa: E402
from specaudit.operators import nulls, scoring  # noqa: E402

log = logging.getLogger("set_audit")

#: Decimals that are written: sums of doubles in another order differ beyond them.
DIGITS = 10
CONFIG = {"sample": "vec_id", "vector": "embedding", "type": "label", "predictor": 0, "n_draws": 20, "n_bins": 10, "seed": 0, "alpha": 0.05}


def scores_and_report(table: DataFrame, sets: dict[str, Sequence[int]], c: dict) -> tuple[DataFrame, DataFrame]:
    """Residual scores of the sets, and one row for each set."""
    spark = table.sparkSession
    rows = table.select(F.col(c["sample"]).alias("sample"), F.expr(c["type"]).alias("type"), F.col(c["vector"]).alias("vector")).filter("sample IS NOT NULL AND type IS NOT NULL")
    finite = F.when(F.abs("value") < float("inf"), F.col("value"))
    expr = rows.select("sample", F.posexplode("vector").alias("gene", "value")).withColumn("value", F.col("value").cast("double")).withColumn("value", finite).filter("value IS NOT NULL")
    types = rows.select("sample", "type")
    prediction = expr.filter(F.col("gene") == c["predictor"]).select("sample", F.col("value").alias("prediction"))
    named = spark.createDataFrame([(s, int(g)) for s, genes in sets.items() for g in genes], "set_name string, gene int")  # from the config file

    # all genes but the predictor are the pool of random sets
    levels = expr.filter(F.col("gene") != c["predictor"]).groupBy("gene").agg(F.avg("value").alias("level"))
    bins = nulls.level_bins(levels, c["n_bins"])
    drawn = nulls.random_sets(named, bins, n_draws=c["n_draws"], seed=c["seed"])
    both = named.select("set_name", F.lit(-1).alias("draw"), "gene").unionByName(drawn)

    axis = axes.global_axis_mean_z(expr).join(types, "sample")
    keyed = both.select(F.concat_ws("|", F.col("draw").cast("string"), "set_name").alias("set_name"), "gene")
    scored = axes.residualise(scoring.score_mean_z(expr, keyed), axis, within="type")
    split = F.split("set_name", "[|]", 2)
    scored = scored.select("sample", "type", F.get(split, F.lit(0)).cast("int").alias("draw"), F.get(split, F.lit(1)).alias("set_name"), "score", "axis", "residual")

    r = scored.join(prediction, "sample").groupBy("set_name", "draw").agg(*(pearson(F.col(x), F.col("prediction")).alias(f"r_{x}") for x in ("score", "axis", "residual")), F.count("residual").alias("n"))
    own = r.filter("draw = -1")
    excess = nulls.excess_over_null(own.select("set_name", F.col("r_residual").alias("r"), "n"), r.filter("draw >= 0").select("set_name", F.col("r_residual").alias("r")), alpha=c["alpha"])
    low, high = corr_interval(F.col("r_residual"), F.col("n"), c["alpha"])
    reliability = scoring.cronbach_alpha(expr, named).select("set_name", F.col("k").alias("n_genes"), F.col("alpha").alias("reliability"))
    report = own.select("set_name", "n", F.col("r_score").alias("r_raw"), "r_axis", "r_residual", low.alias("r_low"), high.alias("r_high")).join(reliability, "set_name", "left").join(excess, "set_name", "left")
    return scored.filter("draw = -1").drop("draw"), report


def run(spark: SparkSession, matrix: str, output: str, config: dict, only: Sequence[str] | None = None) -> DataFrame:
    """Write the partitions of the sets asked for; returns all scores, each with its set's row of the report."""
    c = CONFIG | config
    if unknown := set(only or ()) - set(c["sets"]):
        raise ValueError(f"no sets {sorted(unknown)} in the config")
    sets = {s: genes for s, genes in c["sets"].items() if only is None or s in only}
    table = spark.read.parquet(matrix)
    log.info("read %s rows of %s; %s sets, %s draws", table.count(), matrix, len(sets), c["n_draws"])
    made = dict(zip(("scores", "report"), scores_and_report(table, sets, c), strict=True))
    found = {}
    for name, df in made.items():
        df = df.withColumns({x: F.round(x, DIGITS) for x, kind in df.dtypes if kind == "double"})
        order = [x for x in df.columns if x != "set_name"] + ["set_name"]
        df.select(order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("set_name").parquet(f"{output}/{name}")
        found[name] = spark.read.schema(df.select(order).schema).parquet(f"{output}/{name}")
        log.info("wrote %s: %s rows now", name, found[name].count())
    return found["scores"].join(found["report"], "set_name")


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def main() -> None:
    parser = argparse.ArgumentParser(description="Audits a predictor against named and random feature sets.")
    for name in ("matrix", "output", "config"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--only", nargs="*", default=None)
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("set_audit").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.matrix, given.output, read_config(spark, given.config), given.only)
        spark.read.parquet(f"{given.output}/report").orderBy("set_name").show(200, truncate=False)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
