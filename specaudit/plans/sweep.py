"""Sweeps over split seeds: merging shards, variance between partitions, combined standard errors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import rank_in_order
from ..functions.special import sd_interval
from ..operators.splits import partition_variance


def conflicting_seeds(shards: DataFrame, values: Sequence[str], seed: str = "split_seed") -> DataFrame:
    """Seeds whose rows differ in any value, to the last bit."""
    return shards.groupBy(seed).agg(F.countDistinct(F.struct(*values)).alias("n")).filter("n > 1").select(seed)


def merge_shards(shards: DataFrame, values: Sequence[str], expected: DataFrame | None = None, seed: str = "split_seed", source: str = "source") -> tuple[DataFrame, DataFrame | None]:
    """One row for each seed, from the first source, and the expected seeds that are missing.

    Rows of one seed must agree to the last bit; the merge raises if they don't.
    """
    bad = [r[0] for r in conflicting_seeds(shards, values, seed).limit(5).collect()]
    if bad:
        raise ValueError(f"seeds {bad} have different results in different shards")
    first = shards.withColumn("_r", F.row_number().over(Window.partitionBy(seed).orderBy(source))).filter("_r = 1").drop("_r")
    return first, expected.join(first, seed, "left_anti") if expected is not None else None


def combined_error(per_partition: DataFrame, value: str = "isi", lo: str = "lo", hi: str = "hi", z: float = 1.959963984540054) -> dict[str, float]:
    """sd between partitions with its interval, bootstrap standard error, their combination and an honest interval."""
    v = partition_variance(per_partition, value).first()
    boot = per_partition.agg(F.avg((F.col(hi) - F.col(lo)) / (2 * z)).alias("se")).first()["se"]
    total = math.hypot(boot, v["sd"])
    low, high = sd_interval(v["sd"], v["n"])
    return {"n": v["n"], "mean": v["mean"], "sd": v["sd"], "sd_lo": low, "sd_hi": high, "se_boot": boot, "se_total": total, "share_partition": v["sd"] ** 2 / total**2, "lo": v["mean"] - z * total, "hi": v["mean"] + z * total}


def shard_of(seeds: DataFrame, shards: int, seed: str = "split_seed") -> DataFrame:
    """seeds with ``shard``: consecutive runs of like length, in the order of the seeds."""
    n = seeds.count()
    place = rank_in_order(seeds, seed, name="_p")
    return place.withColumn("shard", F.floor(F.col("_p") * shards / max(n, 1)).cast("int")).drop("_p")


def run_shard(spark: SparkSession, seeds: Sequence[int], run: Callable[[int], dict[str, float]], folder: str, source: str) -> tuple[int, int]:
    """Run each seed of a shard and append ``split_seed, isi, lo, hi, n_signatures, source`` to a table, one row at a time.

    Seeds that the table holds are passed over, so a shard that was stopped goes on where it was. A seed that raises
    is recorded with its reason in the table beside it and doesn't stop the others. Returns how many ran and failed.
    """
    row, refused = "split_seed long, isi double, lo double, hi double, n_signatures long, source string", "split_seed long, kind string, reason string, source string"
    for name, schema in (("per_partition", row), ("refused_partitions", refused)):
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")
    done = {r[0] for name in ("per_partition", "refused_partitions") for r in spark.read.parquet(f"{folder}/{name}").select("split_seed").collect()}  # a number for each seed
    ran = failed = 0
    for s in seeds:
        if s in done:
            continue
        try:
            p = run(s)
            spark.createDataFrame([(s, p["value"], p["lo"], p["hi"], p["n"], source)], row).write.mode("append").parquet(f"{folder}/per_partition")
            ran += 1
        except (ValueError, RuntimeError) as x:
            spark.createDataFrame([(s, type(x).__name__, str(x)[:500], source)], refused).write.mode("append").parquet(f"{folder}/refused_partitions")
            failed += 1
    return ran, failed
