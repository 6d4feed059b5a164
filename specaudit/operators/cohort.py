"""Assembling a cohort: collapsing samples to patients, joining tables, coverage, overlaps, differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_row(columns: Sequence[str], order: Column | str) -> Column:
    """Aggregate: a struct of columns of the row that comes first in an order with unique keys."""
    return F.min_by(F.struct(*columns), order)


def collapse_to_patient(frame: DataFrame, order: str, vector: str | None = "vector", patient: str = "patient_id", how: str = "mean") -> DataFrame:
    """One row for each patient: the first row's metadata, n_slides, and the mean (or first) vector.

    The mean is taken element by element over (patient, position), so no patient's slides meet in one place.
    """
    if how not in ("mean", "first"):
        raise ValueError("how must be mean or first")
    meta = [c for c in frame.columns if c not in (patient, vector)]
    base = frame.groupBy(patient).agg(first_row(meta + ([vector] if vector and how == "first" else []), order).alias("_first"), F.count("*").alias("n_slides"))
    names = meta + ([vector] if vector and how == "first" else [])
    base = base.select(patient, *(F.col(f"_first.{c}").alias(c) for c in names), "n_slides")
    if not vector or how == "first":
        return base
    long = frame.select(patient, F.posexplode(vector)).groupBy(patient, "pos").agg(F.avg("col").alias("v"))
    mean = long.groupBy(patient).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_v"))
    return base.join(mean.select(patient, F.transform("_v", lambda x: x["v"]).alias(vector)), patient, "left")


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(frame: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Raise if a key is null or repeats."""
    bad = frame.filter(" OR ".join(f"`{k}` IS NULL" for k in keys)).select(F.lit(1).alias("x")).unionAll(duplicate_keys(frame, keys).select(F.lit(2).alias("x"))).limit(1).collect()
    if bad:
        raise ValueError(f"{what} has {'null' if bad[0][0] == 1 else 'repeated'} keys in {list(keys)}")


def assemble_cohort(base: DataFrame, tables: Mapping[str, DataFrame], key: str = "patient_id", check: bool = True) -> DataFrame:
    """Left equi-joins of one table after another; clashing names get the table's name after them.

    A repeated key on the right would add rows, and raises. Nothing else is read for the check than keys.
    """
    out = base
    for name, table in tables.items():
        if check and not duplicate_keys(table, [key]).isEmpty():
            raise ValueError(f"joining {name} would change the number of rows")
        clash = [c for c in table.columns if c != key and c in out.columns]
        for c in clash:
            table = table.withColumnRenamed(c, f"{c}_{name}")
        out = out.join(table, key, "left")
    return out


def coverage(frame: DataFrame, tables: Mapping[str, Sequence[str]]) -> DataFrame:
    """``table_name, coverage``: share of rows with a value in each table's first column."""
    one = frame.agg(*(F.avg(F.col(c[0]).isNotNull().cast("double")).alias(name) for name, c in tables.items()))
    stack = ", ".join(f"'{n}', `{n}`" for n in tables)
    return one.selectExpr(f"stack({len(tables)}, {stack}) AS (table_name, coverage)")


def coverage_report(frame: DataFrame, tables: Mapping[str, Sequence[str]], patient: str = "patient_id") -> str:
    n = frame.agg(F.count("*").alias("rows"), F.countDistinct(patient).alias("patients")).first()
    lines = [f"{n['rows']} rows, {n['patients']} patients"]
    for r in coverage(frame, tables).collect():
        lines.append(f"{r['table_name']}: {r['coverage']:.3f}" + ("  <-- CHECK" if r["coverage"] < 0.8 else ""))
    return "\n".join(lines)


def inner_join_checked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that must be unique and present on both sides."""
    assert_unique(left, [key], "left table")
    assert_unique(right, [key], "right table")
    return left.join(right, key)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: numbers of distinct keys on the left only, on the right only and on both sides."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"))


def frame_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``column_name, n_unequal, max_abs_diff`` of the columns of two tables matched by key."""
    cols = [f for f in left.schema.fields if f.name != key and f.name in right.columns]
    j = left.alias("l").join(right.alias("r"), key, "full")
    aggs = []
    for f in cols:
        a, b = F.col(f"l.{f.name}"), F.col(f"r.{f.name}")
        is_float = isinstance(f.dataType, T.FractionalType)
        aggs.append(F.struct(F.lit(f.name).alias("column_name"), F.count_if(~a.eqNullSafe(b)).alias("n_unequal"), (F.max(F.abs(a - b)) if is_float else F.lit(None)).cast("double").alias("max_abs_diff")))
    return j.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def sample_mix(samples: DataFrame, patient: str, code: str, tumour: str = "01") -> DataFrame:
    """``patient, codes, several, no_tumour`` of each patient's sample type codes."""
    g = samples.groupBy(patient).agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return g.select(patient, "codes", (F.size("codes") > 1).alias("several"), (~F.array_contains("codes", tumour)).alias("no_tumour"))


def mean_by_patient(long: DataFrame, patient: Column) -> DataFrame:
    """Expression averaged over the samples of a patient."""
    return long.groupBy(patient.alias("sample"), "gene").agg(F.avg("value").alias("value"))


def first_sample_by_patient(long: DataFrame, patient: Column) -> DataFrame:
    """Expression of each patient's first sample, by name."""
    first = long.select(patient.alias("patient"), "sample").groupBy("patient").agg(F.min("sample").alias("sample"))
    return long.join(first, "sample").select(F.col("patient").alias("sample"), "gene", "value")
