"""Ranks over whole tables without one task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may rank alone; a larger table is cut into ranges of so many, up to MOST_RANGES of them.
SMALL = 100_000
MOST_RANGES = 4096


def boundaries(df: DataFrame, column: str, most: int = MOST_RANGES) -> list:
    """Values that cut a column into ranges of some SMALL rows, from a sample of some 50 values for each; none for a small table."""
    n = df.count()
    if (ranges := min(most, -(-n // SMALL))) <= 1:
        return []
    some = df.select(F.col(column).alias("v")).filter("v IS NOT NULL")
    some = some if n <= 50 * ranges else some.sample(min(1.0, 50 * ranges / n), seed=0)
    values = sorted({r["v"] for r in some.collect() if r["v"] == r["v"]})  # some 50 values for each range; NaN has no place among them
    return values[:: max(1, len(values) // ranges)]


def range_of(column: Column, cuts: list) -> Column:
    """The range of a value: how many of the cuts are at most as large, by halving; 0 for null."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < F.lit(cuts[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return F.when(column.isNull(), F.lit(0)).otherwise(within(0, len(cuts)))


def keyed(df: DataFrame, keys: Sequence[str], name: str) -> tuple[DataFrame, list[str]]:
    """df with its keys as one column that is never null, where null equals null; no column without keys."""
    return (df.withColumn(name, F.struct(*keys)), [name]) if keys else (df, [])


def beside(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the columns of a table of some rows for each range, dealt by the keys like the windows around the join.

    Estimates take df for the smaller side where few of its columns are read, and would broadcast it; the hint says which side is built.
    """
    return df.join(small.hint("shuffle_hash"), list(keys))


def kept(df: DataFrame) -> DataFrame:
    """df computed once: in the session's checkpoint folder, or on the executors if it has none."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def rank_in_order(df: DataFrame, column: str, *ties: str, name: str = "place", by: Sequence[str] = ()) -> DataFrame:
    """df with ``name``, the place from 0 in the order of a column and then of others, by groups.

    A large table is cut into ranges of the column, each ranked by a task of its own; the rows of the ranges before
    it are added from one small table of counts.
    """
    keys = list(by)
    if df.limit(SMALL + 1).count() <= SMALL:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(column, *ties)) - 1).cast("long"))
    # names that no caller has: a key may be called as it likes
    cut, group = keyed(df.withColumn("_rank_range", range_of(F.col(column), boundaries(df, column))), keys, "_rank_group")
    own = [*group, "_rank_range"]
    before = F.coalesce(F.sum("_rank_n").over(Window.partitionBy(*group).orderBy("_rank_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut.groupBy(*own).agg(F.count("*").alias("_rank_n")).select(*own, before.alias("_rank_before"))
    inside = F.row_number().over(Window.partitionBy(*own).orderBy(column, *ties))
    placed = beside(cut.withColumn("_rank_inside", inside), offsets, own).withColumn(name, (F.col("_rank_before") + F.col("_rank_inside") - 1).cast("long"))
    return placed.select(*df.columns, name)


def with_average_rank(df: DataFrame, column: str, name: str, by: Sequence[str] = (), weight: str | None = None, cuts: list | None = None) -> DataFrame:
    """df with ``name``, the rank of a column by groups, ties at their mean; a row may stand for a whole number of rows.

    Ranges as for :func:`rank_in_order`; cuts may come from a smaller table with the same values.
    """
    cuts = boundaries(df, column) if cuts is None else cuts
    cut, group = keyed(df.withColumn("_rank_range", range_of(F.col(column), cuts)), by, "_rank_group")
    own, w = [*group, "_rank_range"], F.lit(1) if weight is None else F.col(weight)
    upto = F.sum(w).over(Window.partitionBy(*own).orderBy(column).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum(w).over(Window.partitionBy(*own, column))
    ranked = cut.withColumn("_rank_inside", upto - (same - 1) / 2)
    if not cuts:
        return ranked.withColumn(name, F.col("_rank_inside")).select(*df.columns, name)
    before = F.coalesce(F.sum("_rank_n").over(Window.partitionBy(*group).orderBy("_rank_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut.groupBy(*own).agg(F.sum(w).alias("_rank_n")).select(*own, before.alias("_rank_before"))
    return beside(ranked, offsets, own).withColumn(name, F.col("_rank_before") + F.col("_rank_inside")).select(*df.columns, name)
