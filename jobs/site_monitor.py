"""Incremental job: how much of each feature of incoming texts is explained by the site that sent them.

    python jobs/site_monitor.py --documents DIR --output DIR --checkpoint DIR [--config FILE]

A predictor that learns the site instead of the content is what an audit of a cohort has to exclude, and a cohort
grows by deliveries. Each run reads, as a file stream with ``availableNow``, only the files of ``documents`` (a folder, a file or a pattern)
that its checkpoint doesn't know, adds up exact moments of the features of their texts by site and type, and ends. The report is made anew from the
moments alone, so no text is ever read twice. It doesn't depend on how files were dealt to runs and batches: all moments
are whole numbers.

``output/moments/batch=N`` holds the moments of a micro-batch. A batch that Spark repeats after a failure has the
same number and overwrites its own partition alone. ``output/report/feature=F`` holds, by type and site:

* ``n_rows``, all rows; ``n``, those with an id and at least ``min_words`` words, which alone enter the rest,
* ``mean, sd, low, high`` of the feature,
* ``gap``: the site's mean less that of the type's other sites, in standard deviations of the type,
* ``site_share``: the share of the feature's variance within the type that lies between sites.

Null sites and types are groups of their own; null texts count as empty. A document delivered twice counts twice.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from specaudit.operators.triage import nonspace_length  # noqa: E402

log = logging.getLogger("site_monitor")

SCHEMA = "doc_id long, text string, lang string, source string"
MOMENTS = "site string, type string, n_rows long, n long, feature string, total decimal(38,0), squares decimal(38,0), low long, high long, batch long"
CONFIG = {"id": "doc_id", "text": "text", "site": "source", "type": "lang", "schema": SCHEMA, "min_words": 1, "files_per_batch": 8}


def text_features(text: Column) -> dict[str, Column]:
    """Whole-number features of a whole text."""
    t = F.coalesce(text, F.lit(""))
    return {
        "n_nonspace": nonspace_length(t).cast("long"),
        "n_words": F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long"),
        "n_lines": F.regexp_count(t, F.lit(r"[^\n]+")).cast("long"),
        "n_upper": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        "n_digits": F.regexp_count(t, F.lit("[0-9]")).cast("long"),
    }


def moments(docs: DataFrame, config: dict) -> DataFrame:
    """Moments of the features by site and type: one partial aggregate, no row for a document and feature."""
    features = text_features(F.col(config["text"]))
    rows = docs.select(F.col(config["site"]).alias("site"), F.col(config["type"]).alias("type"), F.col(config["id"]).alias("id"), *(c.alias(f) for f, c in features.items()))
    kept = F.coalesce(F.col("id").isNotNull() & (F.col("n_words") >= config["min_words"]), F.lit(False))
    aggs = []
    for f in features:
        x = F.when(kept, F.col(f))
        whole = x.cast("decimal(20,0)")
        aggs.append(F.struct(F.lit(f).alias("feature"), F.coalesce(F.sum(whole), F.lit(0)).cast("decimal(38,0)").alias("total"), F.coalesce(F.sum((whole * whole).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("squares"), F.min(x).alias("low"), F.max(x).alias("high")))
    return rows.groupBy("site", "type").agg(F.count("*").alias("n_rows"), F.count_if(kept).alias("n"), F.array(*aggs).alias("f")).select("site", "type", "n_rows", "n", F.inline("f"))


def report(parts: DataFrame) -> DataFrame:
    """The report from the moments of all batches; its rows are as many as sites, types and features."""
    by = ["feature", "type", "site"]
    g = parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n_rows", "n")), *(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("total", "squares")), F.min("low").alias("low"), F.max("high").alias("high"))
    kind = Window.partitionBy("feature", "type")
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    whole = F.col("n").cast("decimal(20,0)")
    g = g.select("*", F.try_divide(total, n).alias("mean"), F.sum("n").over(kind).alias("_n"), F.sum("total").over(kind).cast("decimal(38,0)").alias("_t"), F.sum("squares").over(kind).cast("decimal(38,0)").alias("_q"))
    # n q - t^2 in whole numbers, so a small spread beside a large mean loses nothing
    own = ((whole * F.col("squares")).cast("decimal(38,0)") - (F.col("total") * F.col("total")).cast("decimal(38,0)")).cast("double")
    all_ = ((F.col("_n").cast("decimal(20,0)") * F.col("_q")).cast("decimal(38,0)") - (F.col("_t") * F.col("_t")).cast("decimal(38,0)")).cast("double")
    big, sum_ = F.col("_n").cast("double"), F.col("_t").cast("double")
    between = F.sum(F.coalesce(F.try_divide(total * total, n), F.lit(0.0))).over(kind) * big - sum_ * sum_
    others = F.try_divide(sum_ - total, big - n)
    sd = F.sqrt(F.try_divide(all_, big * (big - 1)))
    return g.select("type", "site", "n_rows", "n", "mean", F.sqrt(F.try_divide(own, n * (n - 1))).alias("sd"), "low", "high", F.try_divide(F.col("mean") - others, sd).alias("gap"), F.try_divide(between, all_).alias("site_share"), "feature")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def pattern(path: str) -> str:
    """A path as a pattern that fits it alone: file streams take a single file only by a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take what is new and return the whole report as it stands. Runs on one output follow one another."""
    c = CONFIG | (config or {})
    if exists(spark, f"{output}/moments") and not exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{output} holds moments, but {checkpoint} is no checkpoint of theirs: all files would count twice")

    def absorb(batch: DataFrame, number: int) -> None:
        made = moments(batch, c).withColumn("batch", F.lit(number).cast("long"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/moments")
        wrote = spark.read.schema(MOMENTS).parquet(f"{output}/moments").filter(F.col("batch") == number).agg(F.count("*"), F.sum(F.when(F.col("feature") == "n_words", F.col("n_rows")))).first()
        log.info("batch %s: read %s documents, wrote %s rows of moments", number, wrote[1] or 0, wrote[0])

    new = spark.readStream.schema(c["schema"]).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(pattern(documents))
    stream = new.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    if not exists(spark, f"{output}/moments"):
        log.info("nothing has been delivered yet")
        return report(spark.createDataFrame([], MOMENTS))
    made = report(spark.read.schema(MOMENTS).parquet(f"{output}/moments"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature").parquet(f"{output}/report")
    out = spark.read.schema(made.schema).parquet(f"{output}/report")
    log.info("report: %s rows in %s", out.count(), f"{output}/report")
    return out


def read_config(spark: SparkSession, path: str | None) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}


def main() -> None:
    parser = argparse.ArgumentParser(description="Adds new documents to the site report.")
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=None)
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("site_monitor").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.documents, given.output, given.checkpoint, read_config(spark, given.config)).orderBy("feature", "type", "site").show(200, truncate=False)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
