"""Sums of vectors and matrices over many tasks, by levels, so that no task and no driver receives all of them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums of a key that one task adds up.
FAN_IN = 64
#: Numbers in a block of a vector or matrix.
BLOCK = 1 << 16


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.float64).tobytes()


def cut(a: np.ndarray, size: int = BLOCK) -> list[bytes]:
    """The numbers of an array, row by row, in packed blocks of one size (the last may be shorter)."""
    flat = np.ascontiguousarray(a, np.float64).ravel()
    return [flat[i : i + size].tobytes() for i in range(0, len(flat), size)]


def joined(blocks: Sequence[bytes]) -> np.ndarray:
    """The numbers of packed blocks, end to end."""
    return np.frombuffer(b"".join(blocks), np.float64)


def count_parts(frame: DataFrame) -> int:
    """The number of partitions of a frame, empty ones at the end aside; a plan that isn't persisted may be run in others."""
    return (frame.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1


def tree_sum(parts: DataFrame, keys: Sequence[str], n_parts: int, fan_in: int = FAN_IN) -> DataFrame:
    """``keys, block``: the sums of ``keys, part long, block binary`` (packed doubles of one length for each key).

    ``part`` is the number of the task that made a partial sum, and n_parts about how many there are. A level adds up fan_in of
    them at a time, the last one all that are left, whatever n_parts said.
    """
    schema = parts.select(*keys, "part", "block").schema

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["block"][0].as_py()) // 8)
        for b in table["block"]:
            total += np.frombuffer(b.as_buffer(), np.float64)
        return table.slice(0, 1).set_column(table.schema.get_field_index("block"), "block", pa.array([total.tobytes()], pa.binary()))

    out, left = parts.select(*keys, "part", "block"), n_parts
    while left > fan_in:
        left = -(-left // fan_in)
        out = out.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy(*keys, "part").applyInArrow(lambda table: add(table), schema)
    return out.groupBy(*keys).applyInArrow(lambda table: add(table), schema).drop("part")
