"""Proportional hazards of a whole table: two scans of rows ordered by time for each Newton step.

A risk set is all rows of the same or a later time, so its sums are running sums. Rows lie in ranges, latest first.
The first scan gives each range's totals; from these the driver makes a carry for each range; the second goes through the
ranges side by side, from their carries. Equal rows are one row with its count, and ranges are cut within equal times too, so
neither a time with very many rows nor the table's size makes a large range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a range.
RANGE_ROWS = 1_000_000


def in_ranges(x: DataFrame, names: Sequence[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``part, time, x array<double>, n, d``: distinct rows of ``time, event`` and named numbers with rows and events, latest first.

    Parts are numbered from the latest on. The caller persists the frame: another evaluation may cut it elsewhere.
    """
    rows = x.select(F.col("time").cast("double").alias("time"), F.array(*(F.col(c).cast("double") for c in names)).alias("x"), F.col("event").cast("double").alias("event"))
    cells = rows.groupBy("time", "x").agg(F.count("*").cast("double").alias("n"), F.sum("event").alias("d")).withColumn("_tie", F.xxhash64("x"))
    ranges = max(1, -(-x.count() // range_rows))
    ordered = cells.repartitionByRange(ranges, F.desc("time"), "_tie").sortWithinPartitions(F.desc("time"), "_tie")
    return ordered.select(F.spark_partition_id().alias("part"), "time", "x", "n", "d")


def _terms(batch: pa.RecordBatch, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Times, each row's terms of the three sums over risk sets, events, and events times covariates."""
    n, p = batch.num_rows, len(beta)
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, p)
    e = batch.column("n").to_numpy(zero_copy_only=False) * np.exp(x @ beta)
    d = batch.column("d").to_numpy(zero_copy_only=False)
    ex = e[:, None] * x
    return batch.column("time").to_numpy(zero_copy_only=False), np.concatenate([e[:, None], ex, (ex[:, :, None] * x[:, None, :]).reshape(n, p * p)], axis=1), d, d[:, None] * x


def range_totals(rows: DataFrame, beta: np.ndarray) -> list[tuple[int, float, float, np.ndarray, np.ndarray]]:
    """Number, first and last time, totals, and totals at the first time, of the ranges that have rows: one row for each."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, head, first, last, me = 0.0, 0.0, None, None, None
        for b in batches:
            if b.num_rows:
                t, m, _, _ = _terms(b, beta)
                first, me = t[0] if first is None else first, b.column("part")[0].as_py() if me is None else me
                total, head, last = total + m.sum(0), head + m[t == first].sum(0), t[-1]
        if me is not None:
            yield pa.RecordBatch.from_pydict({"part": [me], "first": [first], "last": [last], "total": [total.tobytes()], "head": [head.tobytes()]}, schema=pa.schema([("part", pa.int32()), ("first", pa.float64()), ("last", pa.float64()), ("total", pa.binary()), ("head", pa.binary())]))

    found = rows.mapInArrow(part, "part int, first double, last double, total binary, head binary").toLocalIterator()
    return sorted((r["part"], r["first"], r["last"], np.frombuffer(r["total"]), np.frombuffer(r["head"])) for r in found)


def carries(totals: Sequence[tuple[int, float, float, np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each range, the sums of all ranges before it, and what later ranges hold at its last time."""
    out, before = {}, 0.0
    for part, _, _, total, _ in totals:
        out[part] = [before + np.zeros_like(total), np.zeros_like(total)]
        before = before + total
    later: tuple[float, np.ndarray] | None = None  # a time, and the sums at it from a range on
    for part, first, last, total, head in reversed(totals):
        if later is not None and later[0] == last:
            out[part][1] = later[1]
        own = total if first == last else head
        later = (first, own + (later[1] if later is not None and first == last == later[0] else 0.0))
    return {k: tuple(v) for k, v in out.items()}


def gradient(rows: DataFrame, beta: np.ndarray, carry: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and information of the partial likelihood with Breslow ties."""
    p = len(beta)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = extra = held = None
        grad, info = np.zeros(p), np.zeros((p, p))

        def close(m: np.ndarray, d: np.ndarray, dx: np.ndarray) -> np.ndarray:
            """Times that are complete: sums within the range, latest first, added to what runs."""
            nonlocal grad, info
            s = run + np.cumsum(m, axis=0)
            has = d > 0
            s0, mean = s[has, :1], s[has, 1 : p + 1] / s[has, :1]
            grad = grad + (dx[has] - d[has, None] * mean).sum(0)
            spread = s[has, p + 1 :] / s0 - (mean[:, :, None] * mean[:, None, :]).reshape(-1, p * p)
            info = info + (d[has, None] * spread).sum(0).reshape(p, p)
            return s[-1]

        for b in batches:
            if not b.num_rows:
                continue
            if run is None:
                run, extra = carry[b.column("part")[0].as_py()]
            t, m, d, dx = _terms(b, beta)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(t)) + 1))
            m, d, dx = (np.add.reduceat(a, starts, axis=0) for a in (m, d, dx))
            t = t[starts]
            if held is not None:
                if held[0] == t[0]:
                    m[0], d[0], dx[0] = m[0] + held[1], d[0] + held[2], dx[0] + held[3]
                else:
                    run = close(held[1][None], np.array([held[2]]), held[3][None])
            if len(t) > 1:
                run = close(m[:-1], d[:-1], dx[:-1])
            held = (t[-1], m[-1], d[-1], dx[-1])  # its time may go on
        if held is not None:
            close((held[1] + extra)[None], np.array([held[2]]), held[3][None])
            yield pa.RecordBatch.from_pydict({"grad": [grad.tobytes()], "info": [info.tobytes()]}, schema=pa.schema([("grad", pa.binary()), ("info", pa.binary())]))

    grad, info = np.zeros(p), np.zeros(p * p)
    for r in rows.mapInArrow(part, "grad binary, info binary").toLocalIterator():  # a row for each range
        grad, info = grad + np.frombuffer(r["grad"]), info + np.frombuffer(r["info"])
    return grad, info.reshape(p, p)


def newton(rows: DataFrame, p: int, max_iter: int = 50, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray] | None:
    """Coefficients and information of rows from :func:`in_ranges`, persisted; None without convergence."""
    beta = np.zeros(p)
    for _ in range(max_iter):
        totals = range_totals(rows, beta)
        if not totals:
            return None
        grad, info = gradient(rows, beta, carries(totals))
        try:
            step = np.linalg.solve(info, grad)
        except np.linalg.LinAlgError:
            return None
        beta = beta + step
        if not np.isfinite(beta).all():
            return None
        if np.abs(step).max() < tol:
            return beta, info
    return None
