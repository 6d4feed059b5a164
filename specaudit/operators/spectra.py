"""Leading eigenvectors and cross products of many blocks of rows at once, without a task that holds a block.

A block is a group of samples with the members (genes) of the group. A sample's members are one row,
``group, sample, cells array<struct<idx, z>>``, so each task adds up what its own rows give and only sums travel. Groups with
up to GRAM_MEMBERS members get their matrix of cross products, added up in blocks and solved where it comes together. Larger
ones take Lanczos steps: a step is one pass in which each row z adds (z'v) z, all groups side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import BLOCK, count_parts, cut, joined, tree_sum

#: Members up to which a group's cross products are made: 8 MB of them.
GRAM_MEMBERS = 1024
#: Bytes of sums that a task keeps before it hands them on, and of dense rows that it works on at once.
HELD_BYTES = 64 << 20
#: Lanczos vectors of a group that the driver keeps before it starts again from the best one.
BASIS = 24
_CELLS = "array<struct<idx:int,z:double>>"


def as_vectors(long: DataFrame, members: DataFrame) -> DataFrame:
    """``group, sample, cells`` of ``group, sample, gene, z``: the members' z of each sample; missing ones count as 0.

    members: ``group, gene``, numbered within the group by gene. Samples without any member have no cells.
    """
    numbered = members.select("group", "gene", (F.row_number().over(Window.partitionBy("group").orderBy("gene")) - 1).alias("idx"))
    cell = F.when(F.col("idx").isNotNull() & F.col("z").isNotNull(), F.struct(F.col("idx").cast("int").alias("idx"), F.col("z").cast("double").alias("z")))
    return long.join(numbered, ["group", "gene"], "left").groupBy("group", "sample").agg(F.collect_list(cell).alias("cells"))


def about(rows: DataFrame) -> dict[str, tuple[int, float, int]]:
    """Samples, sum of squares and members of each group: a row for each comes to the driver."""
    squares = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["z"] * c["z"])
    g = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum(squares).alias("t"), (F.max(F.array_max("cells.idx")) + 1).alias("k"))
    return {r["group"]: (r["n"], r["t"] or 0.0, r["k"] or 0) for r in g.collect()}


def _flat(batch: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Group of each row, cells of each row, and members and numbers of all cells."""
    import pyarrow.compute as pc

    cells = batch.column("cells")
    inner = cells.flatten()
    lengths = pc.list_value_length(cells).fill_null(0).to_numpy(zero_copy_only=False)
    return batch.column("group").to_pylist(), lengths, inner.field("idx").to_numpy(zero_copy_only=False), inner.field("z").to_numpy(zero_copy_only=False)


def cross_products(rows: DataFrame, sizes: dict[str, int], n_parts: int) -> DataFrame:
    """``group, number, block``: blocks of the k x k sums of zz' of each group, with numbers from 0."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, sums, held = TaskContext.get().partitionId(), {}, 0

        def emit() -> Iterator[pa.RecordBatch]:
            for g, m in sums.items():
                blocks = cut(m)
                yield pa.RecordBatch.from_pydict({"group": [g] * len(blocks), "number": list(range(len(blocks))), "part": [me] * len(blocks), "block": blocks}, schema=schema)

        for b in batches:
            group, lengths, idx, z = _flat(b)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            order: dict[str, list[int]] = {}
            for i, g in enumerate(group):
                if sizes.get(g):
                    order.setdefault(g, []).append(i)
            for g, at in order.items():
                k = sizes[g]
                if g not in sums:
                    if held + 8 * k * k > HELD_BYTES and sums:
                        yield from emit()
                        sums, held = {}, 0
                    sums[g], held = np.zeros((k, k)), held + 8 * k * k
                step = max(1, HELD_BYTES // (8 * k))
                for a in range(0, len(at), step):
                    some = np.array(at[a : a + step])
                    n = lengths[some]
                    where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[some], n)
                    x = np.zeros((len(some), k))
                    x[np.repeat(np.arange(len(some)), n), idx[where]] = z[where]
                    sums[g] += x.T @ x
        yield from emit()

    schema = pa.schema([("group", pa.string()), ("number", pa.int64()), ("part", pa.int64()), ("block", pa.binary())])
    parts = rows.select("group", "cells").mapInArrow(part, "group string, number long, part long, block binary")
    return tree_sum(parts, ["group", "number"], n_parts)


def matrix_of(table: pa.Table) -> np.ndarray:
    """A group's matrix from its blocks."""
    flat = joined([b.as_py() for b in table.sort_by("number")["block"]])
    k = round(len(flat) ** 0.5)
    return flat.reshape(k, k)


def _leading_by_gram(rows: DataFrame, sizes: dict[str, int], n_parts: int) -> dict[str, tuple[float, np.ndarray]]:
    def solve(table: pa.Table) -> pa.Table:
        values, vectors = np.linalg.eigh(matrix_of(table))
        return pa.table({"group": table["group"][:1], "value": [float(values[-1])], "vector": pa.array([vectors[:, -1].tobytes()], pa.binary())})

    solved = cross_products(rows, sizes, n_parts).groupBy("group").applyInArrow(solve, "group string, value double, vector binary")
    return {r["group"]: (r["value"], np.frombuffer(r["vector"])) for r in solved.toLocalIterator()}  # a vector for each group


def apply_sums(rows: DataFrame, base: dict[str, int], v: np.ndarray, n_parts: int) -> np.ndarray:
    """The sums of (z'v) z over each group's rows, groups end to end from their bases; one pass over all rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        w = np.zeros(len(v))
        for b in batches:
            group, lengths, idx, z = _flat(b)
            start = np.array([base.get(g, -1) for g in group], np.int64)
            at = np.repeat(start, lengths)
            ok = at >= 0
            at, z, row = (at + idx)[ok], z[ok], np.repeat(np.arange(len(group)), lengths)[ok]
            u = np.bincount(row, weights=z * v[at], minlength=len(group))
            w += np.bincount(at, weights=z * u[row], minlength=len(v))
        blocks = cut(w)
        yield pa.RecordBatch.from_pydict({"number": list(range(len(blocks))), "part": [TaskContext.get().partitionId()] * len(blocks), "block": blocks}, schema=pa.schema([("number", pa.int64()), ("part", pa.int64()), ("block", pa.binary())]))

    parts = rows.select("group", "cells").mapInArrow(part, "number long, part long, block binary")
    out = np.zeros(len(v))
    for r in tree_sum(parts, ["number"], n_parts).toLocalIterator():
        some = np.frombuffer(r["block"])
        out[r["number"] * BLOCK : r["number"] * BLOCK + len(some)] = some
    return out


class Lanczos:
    """Steps towards a matrix's leading eigenvector; only products with vectors are asked for."""

    def __init__(self, k: int, seed: int, tol: float):
        self.tol, self.done, self.value = tol, False, 0.0
        self.start(np.random.default_rng(seed).normal(size=k))

    def start(self, v: np.ndarray) -> None:
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []
        self.vector = self.basis[0]

    def take(self, w: np.ndarray) -> None:
        """The product with the last vector of the basis."""
        v, q = self.basis[-1], np.array(self.basis)
        self.alpha.append(float(v @ w))
        for _ in range(2):
            w = w - q.T @ (q @ w)
        b = float(np.linalg.norm(w))
        t = np.diag(self.alpha) + np.diag(self.beta, 1) + np.diag(self.beta, -1)
        values, vectors = np.linalg.eigh(t)
        self.value, self.vector = float(values[-1]), q.T @ vectors[:, -1]
        if b * abs(vectors[-1, -1]) <= self.tol * max(abs(self.value), 1e-300) or b == 0.0:
            self.done = True
        elif len(self.basis) >= BASIS:
            self.start(self.vector)
        else:
            self.beta.append(b)
            self.basis.append(w / b)


def _leading_by_lanczos(rows: DataFrame, sizes: dict[str, int], n_parts: int, tol: float, max_passes: int) -> dict[str, tuple[float, np.ndarray]]:
    states = {g: Lanczos(k, i, tol) for i, (g, k) in enumerate(sorted(sizes.items()))}
    for _ in range(max_passes):
        active = {g: s for g, s in states.items() if not s.done}
        if not active:
            break
        base, end = {}, 0
        for g in active:
            base[g], end = end, end + sizes[g]
        w = apply_sums(rows, base, np.concatenate([s.basis[-1] for s in active.values()]), n_parts)
        for g, s in active.items():
            s.take(w[base[g] : base[g] + sizes[g]])
    if late := [g for g, s in states.items() if not s.done]:
        raise RuntimeError(f"no leading eigenvector of {late[:5]} within {max_passes} passes")
    return {g: (s.value, s.vector / np.linalg.norm(s.vector)) for g, s in states.items()}


def leading(rows: DataFrame, sizes: dict[str, int], gram_members: int = GRAM_MEMBERS, tol: float = 1e-10, max_passes: int = 500) -> dict[str, tuple[float, np.ndarray]]:
    """Leading eigenvalue and unit eigenvector of each group's sum of zz', the vector's sum not negative. rows should be persisted.

    With sizes the numbers of members. Scores z'v then don't fall with the mean z: their product over all rows is the
    eigenvalue times the vector's sum.
    """
    n_parts = count_parts(rows)
    few = {g: k for g, k in sizes.items() if 0 < k <= gram_members}
    many = {g: k for g, k in sizes.items() if k > gram_members}
    found = _leading_by_gram(rows, few, n_parts) if few else {}
    found |= _leading_by_lanczos(rows, many, n_parts, tol, max_passes) if many else {}
    return {g: (value, -v if v.sum() < 0 else v) for g, (value, v) in found.items()}


def project(rows: DataFrame, vectors: dict[str, np.ndarray], numbers: dict[str, float], name: str, other: str) -> DataFrame:
    """``sample, group`` with z'v under a name and a number of the group under another, of the groups that have a vector."""
    base, end = {}, 0
    for g, v in vectors.items():
        base[g], end = end, end + len(v)
    flat = np.concatenate([*vectors.values(), np.zeros(0)])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, lengths, idx, z = _flat(b)
            keep = np.array([g in base for g in group], bool)
            start = np.repeat(np.array([base.get(g, 0) for g in group], np.int64), lengths)
            ok = np.repeat(keep, lengths)
            row = np.repeat(np.arange(len(group)), lengths)[ok]
            u = np.bincount(row, weights=z[ok] * flat[(start + idx)[ok]], minlength=len(group))
            rows_ = pa.array(np.flatnonzero(keep))
            kept = [group[i] for i in np.flatnonzero(keep)]
            yield pa.RecordBatch.from_arrays([b.column("sample").take(rows_), pa.array(kept, pa.string()), pa.array(u[keep]), pa.array([numbers[g] for g in kept], pa.float64())], ["sample", "group", name, other])

    kind = dict(rows.dtypes)["sample"]
    return rows.mapInArrow(part, f"sample {kind}, group string, {name} double, {other} double")
