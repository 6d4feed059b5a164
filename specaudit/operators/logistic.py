"""Many logistic models of one matrix at once: a scan adds up the gradients of all of them, no model has a copy of the rows.

Models are one-against-rest for a label's values, each for every fold, on the rows of the other folds. All share the
features' cross products by fold, which give each model the exact curvature at its prevalence; from there limited-memory quasi-Newton steps
are taken, a scan a step. What comes to the driver is a gradient for each model, summed by levels in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import BLOCK, cut, joined, tree_sum

#: Bytes of gradients, and of scores in a task, that are worked on at once; more models take turns.
MODEL_BYTES = 64 << 20
HISTORY = 10


def rows_of(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def fold_products(frame: DataFrame, centre: np.ndarray, n_parts: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, sums and cross products of ``fold, x`` about a centre by fold, added up in blocks by levels."""
    p = len(centre)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x, fold = rows_of(b.column("x")), b.column("fold").to_numpy()
            for k in np.unique(fold).tolist():
                a = np.column_stack([np.ones((fold == k).sum()), x[fold == k] - centre])
                sums[k] = sums.get(k, 0) + a.T @ a
        me = TaskContext.get().partitionId()
        for k, m in sums.items():
            blocks = cut(m)
            yield pa.RecordBatch.from_pydict({"fold": [k] * len(blocks), "number": list(range(len(blocks))), "part": [me] * len(blocks), "block": blocks}, schema=schema)

    schema = pa.schema([("fold", pa.int64()), ("number", pa.int64()), ("part", pa.int64()), ("block", pa.binary())])
    parts = frame.select(F.col("fold").cast("long").alias("fold"), "x").mapInArrow(part, "fold long, number long, part long, block binary")
    found: dict[int, dict[int, bytes]] = {}
    for r in tree_sum(parts, ["fold", "number"], n_parts).toLocalIterator():
        found.setdefault(r["fold"], {})[r["number"]] = bytes(r["block"])
    out = {}
    for k, blocks in found.items():
        m = joined([blocks[i] for i in sorted(blocks)]).reshape(p + 1, p + 1)
        out[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


@dataclass
class Training:
    """What the rows outside a fold have in common for all models: size, means, scales and axes of their features."""

    n: float
    mean: np.ndarray
    scale: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def training(products: dict[int, tuple[float, np.ndarray, np.ndarray]], fold: int) -> Training:
    others = [v for k, v in products.items() if k != fold]
    n, s, m = (sum(v[i] for v in others) for i in range(3))
    mean = s / n
    cov = m / n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(cov), 0, None))
    scale = np.where(scale > 1e-12, scale, 1.0)
    values, vectors = np.linalg.eigh(n * cov / np.outer(scale, scale))
    return Training(n, mean, scale, np.clip(values, 0, None), vectors)


@dataclass
class Model:
    """One model's state: intercept and weights of scaled features, and its search."""

    label: object
    fold: int
    prevalence: float
    at: np.ndarray
    loss: float = np.inf
    grad: np.ndarray | None = None
    step: np.ndarray | None = None
    length: float = 1.0
    pairs: list = field(default_factory=list)
    done: bool = False

    def solve(self, t: Training, c: float, g: np.ndarray) -> np.ndarray:
        """The inverse curvature at the prevalence, times g."""
        h = self.prevalence * (1 - self.prevalence)
        return np.concatenate([[g[0] / (t.n * h)], t.vectors @ ((t.vectors.T @ g[1:]) / (h * t.values + 1 / c))])

    def direction(self, t: Training, c: float) -> np.ndarray:
        q, kept = self.grad.copy(), []
        for s, y, rho in reversed(self.pairs):
            a = rho * (s @ q)
            q -= a * y
            kept.append(a)
        d = self.solve(t, c, q)
        if self.pairs:
            s, y, _ = self.pairs[-1]
            d *= (s @ y) / (y @ self.solve(t, c, y))
        for (s, y, rho), a in zip(self.pairs, reversed(kept), strict=True):
            d += s * (a - rho * (y @ d))
        return -d

    def trial(self) -> np.ndarray:
        return self.at if self.step is None else self.at + self.length * self.step

    def take(self, loss: float, grad: np.ndarray, t: Training, c: float, tol: float) -> None:
        """Loss and gradient at the trial point."""
        if self.step is not None:
            if not (loss <= self.loss + 1e-4 * self.length * (self.grad @ self.step) + 1e-12 * abs(self.loss)):
                self.length /= 2
                self.done = self.length < 1e-8
                return
            s, y = self.length * self.step, grad - self.grad
            if s @ y > 1e-14:
                self.pairs = [*self.pairs, (s, y, 1 / (s @ y))][-HISTORY:]
            self.at = self.at + s
        self.loss, self.grad = loss, grad
        self.step, self.length = self.direction(t, c), 1.0
        self.done = bool(np.abs(self.step).max() < tol)


def _raw(m: Model, t: Training) -> tuple[np.ndarray, float]:
    """Weights of centred, unscaled features and the intercept at the trial point."""
    u = m.trial()
    w = u[1:] / t.scale
    return w, u[0] - t.mean @ w


def scan(frame: DataFrame, labels: Sequence, models: Sequence[Model], weights: np.ndarray, intercepts: np.ndarray, centre: np.ndarray, n_parts: int) -> np.ndarray:
    """For each model the loss, the sum of residuals and the residuals times the features, over the rows of other folds."""
    of = {v: i for i, v in enumerate(labels)}
    own, fold = np.array([of[m.label] for m in models]), np.array([m.fold for m in models])
    width = len(centre) + 2

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((len(own), width))
        for b in batches:
            x, k = rows_of(b.column("x")), b.column("fold").to_numpy()
            y = np.array([of.get(v, -1) for v in b.column("label").to_pylist()])
            step = max(1, MODEL_BYTES // (8 * len(own)))
            for a in range(0, len(x), step):
                xs = x[a : a + step] - centre
                z = xs @ weights.T + intercepts
                hit, used = y[a : a + step, None] == own, k[a : a + step, None] != fold
                total[:, 0] += ((np.logaddexp(0, z) - np.where(hit, z, 0)) * used).sum(0)
                r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - hit) * used
                total[:, 1] += r.sum(0)
                total[:, 2:] += r.T @ xs
        blocks = cut(total)
        yield pa.RecordBatch.from_pydict({"number": list(range(len(blocks))), "part": [TaskContext.get().partitionId()] * len(blocks), "block": blocks}, schema=pa.schema([("number", pa.int64()), ("part", pa.int64()), ("block", pa.binary())]))

    out = np.zeros(len(own) * width)
    for r in tree_sum(frame.select("fold", "label", "x").mapInArrow(part, "number long, part long, block binary"), ["number"], n_parts).toLocalIterator():
        some = np.frombuffer(r["block"])
        out[r["number"] * BLOCK : r["number"] * BLOCK + len(some)] = some
    return out.reshape(len(own), width)


def fit(frame: DataFrame, wanted: Sequence[tuple[object, int, float]], products: dict[int, tuple[float, np.ndarray, np.ndarray]], centre: np.ndarray, n_parts: int, c: float = 1.0, tol: float = 1e-8, max_scans: int = 200) -> dict[tuple[object, int], tuple[np.ndarray, float]]:
    """Weights of the features as given and intercepts, by label and fold, of L2-penalised models (the intercept isn't).

    frame: ``fold, label, x``, persisted; wanted: label, fold and the label's share of the rows outside the fold, between 0 and 1.
    Raises if a model hasn't come to rest within max_scans scans.
    """
    of_fold = {k: training(products, k) for k in {k for _, k, _ in wanted}}
    at_once = max(1, MODEL_BYTES // (8 * (len(centre) + 2)))
    out = {}
    for first in range(0, len(wanted), at_once):
        models = [Model(v, k, share, np.concatenate([[np.log(share / (1 - share))], np.zeros(len(centre))])) for v, k, share in wanted[first : first + at_once]]
        for _ in range(max_scans):
            active = [m for m in models if not m.done]
            if not active:
                break
            raw = [_raw(m, of_fold[m.fold]) for m in active]
            sums = scan(frame, sorted({m.label for m in active}), active, np.array([w for w, _ in raw]), np.array([b for _, b in raw]), centre, n_parts)
            for m, row in zip(active, sums, strict=True):
                t, u = of_fold[m.fold], m.trial()
                grad = np.concatenate([[row[1]], (row[2:] - t.mean * row[1]) / t.scale + u[1:] / c])
                m.take(row[0] + 0.5 * u[1:] @ u[1:] / c, grad, t, c, tol)
        if late := [(m.label, m.fold) for m in models if not m.done]:
            raise RuntimeError(f"{len(late)} models, of {late[:3]}, have not come to rest within {max_scans} scans")
        for m in models:
            m.step = None
            w, b = _raw(m, of_fold[m.fold])
            out[m.label, m.fold] = (w, float(b - centre @ w))
    return out


def score_rows(frame: DataFrame, models: dict[tuple[object, int], tuple[np.ndarray, float]], kind: str) -> DataFrame:
    """``site, label, score``: every row of ``fold, label, x`` under all models of its own fold; label 1 where it is the model's."""
    by_fold: dict[int, list] = {}
    for (v, k), (w, b) in models.items():
        by_fold.setdefault(k, []).append((v, w, b))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold, y = rows_of(batch.column("x")), batch.column("fold").to_numpy(), batch.column("label")
            for k, own in by_fold.items():
                at = np.flatnonzero(fold == k)
                ys = np.array(y.take(pa.array(at)).to_pylist(), object)
                for v, w, b in own:
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), y.type), pa.array((ys == v).astype(np.int32)), pa.array(x[at] @ w + b)], ["site", "label", "score"])

    return frame.select("fold", "label", "x").mapInArrow(part, f"site {kind}, label int, score double")
