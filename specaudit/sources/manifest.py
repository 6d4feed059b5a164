"""File manifests by content hash, and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, sha256, length`` of the files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("sha256"), "length")


def compare_manifests(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """``path, status``: NEW, MISSING, CHANGED or SAME for each path of either side."""
    j = recorded.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full")
    status = F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "MISSING").when(F.col("a") != F.col("b"), "CHANGED").otherwise("SAME")
    return j.select("path", status.alias("status"))


def fingerprint_status(recorded: str | None, observed: str) -> str:
    """absent, match or mismatch."""
    return "absent" if not recorded else "match" if recorded == observed else "mismatch"


def verify_builds(found: DataFrame, recorded: DataFrame, builds: DataFrame | None = None, differences: DataFrame | None = None, tolerance: float = 1e-12) -> DataFrame:
    """``path, verdict`` of files ``path, sha256`` against recorded hashes.

    BYTE-IDENTICAL; KNOWN BUILD and its name, for a hash among ``builds`` (``path, sha256, build``); of other files with
    a row in ``differences`` (``path, exact, max_abs_diff``) CONTENT-EQUAL, NUMERICALLY EQUAL or CONTENT DIFFERS; else
    BYTES DIFFER.
    """
    j = found.select("path", "sha256").join(recorded.select("path", F.col("sha256").alias("want")), "path", "left")
    verdict = F.when(F.col("sha256") == F.col("want"), "BYTE-IDENTICAL")
    if builds is not None:
        j = j.join(builds.select("path", "sha256", "build"), ["path", "sha256"], "left")
        verdict = verdict.when(F.col("build").isNotNull(), F.concat(F.lit("KNOWN BUILD "), "build"))
    if differences is not None:
        j = j.join(differences.select("path", "exact", "max_abs_diff"), "path", "left")
        verdict = verdict.when(F.col("exact") & (F.col("max_abs_diff") == 0), "CONTENT-EQUAL").when(F.col("exact") & (F.col("max_abs_diff") <= tolerance), "NUMERICALLY EQUAL").when(F.col("exact").isNotNull(), "CONTENT DIFFERS")
    return j.select("path", verdict.otherwise("BYTES DIFFER").alias("verdict"))


def stage_hash(frame: DataFrame) -> DataFrame:
    """One row ``n, sha256``: a hash of a table's rows in any order, by a tree of hashes.

    Rows' hashes are grouped by their first four digits, sorted and hashed, then by two, then all: no group is large.
    """
    row = F.sha2(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}), 256)
    level = frame.select(row.alias("h"), F.lit(1).cast("long").alias("n"))
    for digits in (4, 2, 0):
        level = level.groupBy(F.left("h", F.lit(digits)).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias("all"), F.sum("n").alias("n"))
        level = level.select(F.concat("k", F.sha2("all", 256)).alias("h"), "n")
    return level.select("n", F.col("h").alias("sha256"))


def staged_hashes(stages: dict[str, DataFrame]) -> DataFrame:
    """``stage, place, n, sha256`` of named tables, in order: the first that differs between two runs is where they part."""
    out = None
    for place, (name, frame) in enumerate(stages.items()):
        one = stage_hash(frame).select(F.lit(name).alias("stage"), F.lit(place).alias("place"), "n", "sha256")
        out = one if out is None else out.unionByName(one)
    return out
