"""Attrition of a cohort through filters, sizes of sets, and direction-aware significance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import z_of
from .nulls import bh_fdr


def attrition(frame: DataFrame, steps: Sequence[tuple[str, Column]], patient: str, group: str | None = None) -> DataFrame:
    """``(group,) step, place, n_rows, n_patients``: what is left after each filter, all in one pass.

    A row reaches the step before the first test that it fails, a patient the last one that a row of it reaches, so patients
    are told apart once and not for each step. Rows without a patient count as rows only.
    """
    by, passed, reached = [group] if group else [], F.lit(True), F.lit(0)
    for _, test in steps:
        passed = passed & F.coalesce(test, F.lit(False))
        reached = reached + passed.cast("int")
    names = ["all", *(name for name, _ in steps)]
    rows = frame.select(*by, F.col(patient).alias("_p"), reached.alias("_r"))
    one = rows.groupBy(*by, "_p").agg(F.max("_r").alias("_last"), *(F.count_if(F.col("_r") >= k).alias(f"_n{k}") for k in range(len(names))))
    aggs = [F.struct(F.lit(name).alias("step"), F.lit(k).alias("place"), F.coalesce(F.sum(f"_n{k}"), F.lit(0)).cast("long").alias("n_rows"), F.count_if(F.col("_p").isNotNull() & (F.col("_last") >= k)).alias("n_patients")) for k, name in enumerate(names)]
    return one.groupBy(*by).agg(F.array(*aggs).alias("a")).select(*by, F.inline("a"))


def spread(frame: DataFrame, value: str, *keys: str) -> DataFrame:
    """``n, median, q1, q3, min, max``."""
    g = frame.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("_q"), F.min(value).alias("min"), F.max(value).alias("max"))
    return g.select(*keys, "n", *(F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(("median", "q1", "q3"))), "min", "max")


def filter_set_names(sets: DataFrame, excluded_prefixes: Sequence[str] = (), allowed: Sequence[str] | None = None) -> DataFrame:
    """Sets whose name has none of the prefixes and, if a list is given, is on it."""
    keep = F.lit(True)
    for p in excluded_prefixes:
        keep = keep & ~F.col("set_name").startswith(p)
    return sets.filter(keep & (F.col("set_name").isin(list(allowed)) if allowed is not None else F.lit(True)))


def set_size_stats(sets: DataFrame) -> DataFrame:
    """``n_sets, smallest, upper_median, largest``: the median is the upper of two middle ones."""
    sizes = sets.groupBy("set_name").agg(F.countDistinct("gene").alias("k"))
    ordered = sizes.agg(F.array_sort(F.collect_list("k")).alias("k"))  # a number for each set
    return ordered.select(F.size("k").alias("n_sets"), F.get("k", F.lit(0)).alias("smallest"), F.get("k", F.floor(F.size("k") / 2).cast("int")).alias("upper_median"), F.element_at("k", -1).alias("largest"))


def nonspace_length(text: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(text, r"\s", ""))


def significance(frame: DataFrame, value: str = "excess_z", lo: str = "lo", hi: str = "hi", key: str = "set_name", family: str | None = None, alpha: float = 0.05) -> DataFrame:
    """frame with ``z_stat``, ``p``, ``q`` and ``beats_null_bh`` (rejected and above the null), p from the interval's width.

    Spark has no error function, so p comes from the standard library's erfc over Arrow batches.
    """

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(x / math.sqrt(2)), na_action="ignore")

    z = F.abs(F.col(value) / ((F.col(hi) - F.col(lo)) / (2 * z_of(1 - alpha / 2))))
    out = bh_fdr(frame.withColumn("z_stat", z).withColumn("p", two_sided("z_stat")), "p", key, family, alpha)
    return out.withColumn("beats_null_bh", F.col("rejected") & (F.col(value) > 0)).drop("rejected")
