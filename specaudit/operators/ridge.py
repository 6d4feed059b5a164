"""Ridge regression of many targets from distributed sufficient statistics.

Rows are ``key, fold, x array<double>, y array<double>``. One Arrow pass adds up, for each fold and each class of targets
that are missing in the same rows, the counts, sums and cross products, by levels in blocks; the training statistics of a fold are
the sums of the others. The driver solves matrices of the number of features, and a second pass applies the coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import count_parts, cut, joined, tree_sum

#: Bytes of sums that a task keeps before it hands them on.
HELD_BYTES = 64 << 20
#: Bytes of the targets' sums of all folds that a task holds in a scan; more targets take another.
TARGET_BYTES = 128 << 20
#: Rows up to which a feature's median is taken from its values in one place.
MEDIAN_ROWS = 100_000
#: Fixed grid of penalties.
ALPHAS = tuple(float(a) for a in np.logspace(-2, 5, 24))
MIN_TRAIN = 10


def narrowed_medians(frame: DataFrame, x: str = "x") -> np.ndarray:
    """Exact medians of all features at once, by eight scans that each fix a byte of the two middle values.

    Doubles are taken as whole numbers of the same order. A scan counts, by feature, the next byte of the values that begin with the bytes
    found so far; what travels is 256 counts a feature and task, added up by levels. No task holds a feature's values.
    """
    rows = frame.select(F.col(x).alias("x"))
    n_parts = count_parts(rows)
    first = rows.filter(F.size("x") > 0).first()
    p = len(first["x"]) if first else 0
    prefix, rank, counts = np.zeros((2, p), np.uint64), np.zeros((2, p), np.int64), None

    def counted(shift: int) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros((2, p, 256))
            for b in batches:
                v = _matrix(b.column("x")) + 0.0  # one zero
                at = ~np.isnan(v)
                bits = v.view(np.uint64)
                order = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
                digit = ((order >> np.uint64(shift)) & np.uint64(255)).astype(np.int64) + 256 * np.arange(p)
                for t in range(2):
                    same = at if shift == 56 else at & (order >> np.uint64(shift + 8) == prefix[t])
                    total[t] += np.bincount(digit[same], minlength=256 * p).reshape(p, 256)
            blocks = cut(total)
            yield pa.RecordBatch.from_pydict({"number": list(range(len(blocks))), "part": [TaskContext.get().partitionId()] * len(blocks), "block": blocks}, schema=pa.schema([("number", pa.int64()), ("part", pa.int64()), ("block", pa.binary())]))

        found = {r["number"]: bytes(r["block"]) for r in tree_sum(rows.mapInArrow(part, "number long, part long, block binary"), ["number"], n_parts).toLocalIterator()}
        return joined([found[i] for i in sorted(found)]).reshape(2, p, 256)

    for shift in range(56, -8, -8) if p else ():
        seen = counted(shift)
        if counts is None:
            counts = seen[0].sum(1).astype(np.int64)
            rank[:] = np.maximum(counts - 1, 0) // 2, counts // 2
        upto = seen.cumsum(2)
        digit = np.minimum((upto <= rank[:, :, None]).sum(2), 255)
        rank -= np.where(digit > 0, np.take_along_axis(upto, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0).astype(np.int64)
        prefix = (prefix << np.uint64(8)) | digit.astype(np.uint64)
    bits = np.where(prefix >> np.uint64(63), prefix & np.uint64((1 << 63) - 1), ~prefix)
    low, high = bits.view(np.float64) if p else np.zeros((2, 0))
    return np.where(counts > 0, 0.5 * low + 0.5 * high, 0.0) if p else np.zeros(0)


def impute_medians(frame: DataFrame, x: str = "x") -> DataFrame:
    """``pos, median`` over all rows: exact medians ignoring missing values, 0 for features without any.

    Beyond MEDIAN_ROWS rows by :func:`narrowed_medians`.
    """
    if frame.limit(MEDIAN_ROWS + 1).count() > MEDIAN_ROWS:
        return frame.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(narrowed_medians(frame, x))], "pos int, median double")
    long = frame.select(F.posexplode(x))
    v = F.when(~F.isnan("col"), F.col("col"))
    return long.groupBy("pos").agg(F.coalesce(F.median(v), F.lit(0.0)).alias("median"))


def apply_medians(frame: DataFrame, medians: DataFrame, x: str = "x") -> DataFrame:
    """frame with missing features replaced by given medians (``pos, median``, one small row for each feature)."""
    fill = medians.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "median"))), lambda m: m["median"]).alias("_m"), F.lit(1).alias("_one"))
    out = frame.join(F.broadcast(fill), F.lit(1) == F.col("_one"))  # one row
    return out.withColumn(x, F.zip_with(x, "_m", lambda v, m: F.coalesce(F.when(~F.isnan(v), v), m))).drop("_m", "_one")


def fold_medians(frame: DataFrame, n_folds: int, x: str = "x", fold: str = "fold") -> np.ndarray:
    """Training medians of each fold (folds x features)."""
    out = []
    for k in range(n_folds):
        rows = impute_medians(frame.filter(F.col(fold) != k), x).orderBy("pos").collect()
        out.append([r["median"] for r in rows])
    return np.array(out)


def has_missing(frame: DataFrame, x: str = "x") -> bool:
    return not frame.filter(F.exists(x, lambda v: v.isNull() | F.isnan(v))).isEmpty()


def feature_means(frame: DataFrame, x: str = "x") -> np.ndarray:
    """Means of the features that are there; 0 for those that never are."""
    rows = frame.select(F.posexplode(x)).groupBy("pos").agg(F.avg(F.when(~F.isnan("col"), F.col("col"))).alias("m")).collect()
    return np.array([r["m"] or 0.0 for r in sorted(rows, key=lambda r: r["pos"])])


def fill(frame: DataFrame, values: Sequence[float], x: str = "x") -> DataFrame:
    """frame with missing features replaced."""
    given = F.array(*(F.lit(float(v)) for v in values))
    return frame.withColumn(x, F.zip_with(x, given, lambda v, m: F.coalesce(F.when(~F.isnan(v), v), m)))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


@dataclass
class Moments:
    """Counts, sums and cross products of features and targets, about a fixed centre."""

    n: int
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray


@dataclass
class FoldMoments:
    """Moments by fold. Targets that are missing in the same rows are one class; class 0 is missing in none.

    Features' moments are there for all rows of a fold and for the rows that lack each class; a target's own products
    are over the rows that have it.
    """

    classes: np.ndarray
    n_parts: int
    rows: dict[int, dict[int, tuple[float, np.ndarray, np.ndarray]]]
    targets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def alike(self, targets: Sequence[int]) -> list[list[int]]:
        """Targets that share their rows."""
        found: dict[int, list[int]] = {}
        for t in targets:
            found.setdefault(int(self.classes[t]), []).append(t)
        return list(found.values())

    def training(self, fold: int, target: int) -> Moments | None:
        """Moments over the rows of other folds that have a target."""
        return self._over([k for k in self.rows if k != fold], target)

    def own(self, fold: int, target: int) -> Moments | None:
        """Moments over the rows of a fold that have a target."""
        return self._over([k for k in self.rows if k == fold], target)

    def _over(self, folds: Sequence[int], target: int) -> Moments | None:
        c, total = int(self.classes[target]), None
        for k, parts in self.rows.items():
            if k in folds:
                own = parts[0]
                if c and c in parts:
                    own = tuple(x - y for x, y in zip(own, parts[c], strict=True))
                now = (*own, *self.targets[k])
                total = now if total is None else tuple(x + y for x, y in zip(total, now, strict=True))
        if total is None or total[0] < 0.5:
            return None
        n, sx, xx, sy, xy, yy = total
        return Moments(round(n), sx, sy, xx, xy, yy)


def target_classes(frame: DataFrame) -> np.ndarray:
    """A number for each target: 0 without missing values, else one for all targets that are missing in the same rows.

    These are told by the exclusive or of 128 bits of their rows' keys, and their number; a row for each target that is ever
    missing comes to the driver.
    """
    width = frame.select(F.size("y").alias("n")).first()
    lost = lambda v: v.isNull() | F.isnan(v)
    keyed = frame.filter(F.exists("y", lost)).select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit("row"), "key").alias("b"), F.posexplode(F.transform("y", lost)).alias("target", "lost"))
    seen = keyed.filter("lost").groupBy("target").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("n")).collect()
    out, names = np.zeros(width["n"] if width else 0, np.int64), {}
    for r in seen:
        out[r["target"]] = names.setdefault((r["a"], r["b"], r["n"]), len(names) + 1)
    return out


def moments(frame: DataFrame, centre: np.ndarray | None = None, classes: np.ndarray | None = None, n_parts: int | None = None) -> FoldMoments:
    """Moments by fold; missing features must have been filled in.

    Tasks add up their own rows, and blocks of the sums are added by levels, so neither a task nor the driver gets all
    partial sums. What comes to the driver is p x p numbers for each fold, and for each fold and class of targets with
    missing values. Of these a task holds some 64 MB, and hands them on beyond that; the number of patterns of missing
    targets plays no part. Classes of the targets and the number of partitions may be given where they are known.
    """
    classes = target_classes(frame) if classes is None else classes
    n_parts = count_parts(frame) if n_parts is None else n_parts
    lacking = {int(c): int(np.flatnonzero(classes == c)[0]) for c in np.unique(classes) if c}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, acc, held = TaskContext.get().partitionId(), {}, 0

        def emit() -> Iterator[pa.RecordBatch]:
            for (fold, c), v in acc.items():
                blocks = cut(v)
                yield pa.RecordBatch.from_pydict({"fold": [fold] * len(blocks), "class": [c] * len(blocks), "number": list(range(len(blocks))), "part": [me] * len(blocks), "block": blocks}, schema=schema)

        for b in batches:
            x, y, fold = _matrix(b.column("x")), _matrix(b.column("y")), b.column("fold").to_numpy()
            if centre is not None:
                x = x - centre
            gone = np.isnan(y)
            y = np.nan_to_num(y)
            for k in np.unique(fold).tolist():
                at = fold == k
                xs, ys = x[at], y[at]
                sums = {-1: np.concatenate([ys.sum(0), (ys**2).sum(0), (xs.T @ ys).ravel()])}
                for c, t in [(0, None), *lacking.items()]:
                    own = xs if t is None else xs[gone[at, t]]
                    if len(own):
                        sums[c] = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                for c, v in sums.items():
                    if (k, c) in acc:
                        acc[k, c] += v
                        continue
                    if held + v.nbytes > HELD_BYTES and acc:
                        yield from emit()
                        acc, held = {}, 0
                    acc[k, c], held = v, held + v.nbytes
        yield from emit()

    schema = pa.schema([("fold", pa.int64()), ("class", pa.int64()), ("number", pa.int64()), ("part", pa.int64()), ("block", pa.binary())])
    rows = frame.select(F.col("fold").cast("long").alias("fold"), "x", "y")
    parts = rows.mapInArrow(part, "fold long, class long, number long, part long, block binary")
    found: dict[tuple[int, int], dict[int, bytes]] = {}
    for r in tree_sum(parts, ["fold", "class", "number"], n_parts).toLocalIterator():
        found.setdefault((r["fold"], r["class"]), {})[r["number"]] = bytes(r["block"])
    out, t = FoldMoments(classes, n_parts, {}, {}), len(classes)
    for (k, c), blocks in found.items():
        v = joined([blocks[i] for i in sorted(blocks)])
        if c < 0:
            out.targets[k] = (v[:t], v[2 * t :].reshape(-1, t), v[t : 2 * t])
        else:
            p = round((-1 + (4 * len(v) - 3) ** 0.5) / 2)  # 1 + p + p^2 numbers
            out.rows.setdefault(k, {})[c] = (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p))
    return out


def training_moments(by: FoldMoments, fold: int, target: int) -> Moments | None:
    """Moments over the rows of other folds that have a target."""
    return by.training(fold, target)


def solve(m: Moments, targets: Sequence[int], alpha: float, standardise: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (features x targets) and intercepts, on the scale of the features given."""
    mean, ymean = m.sx / m.n, m.sy[list(targets)] / m.n
    cov = m.xx / m.n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(cov), 0, None)) if standardise else np.ones(len(mean))
    scale = np.where(scale > 1e-12, scale, 1.0)
    gram = m.n * cov / np.outer(scale, scale)
    rhs = (m.xy[:, list(targets)] - np.outer(m.sx, ymean)) / scale[:, None]
    if alpha > 0:
        beta = np.linalg.solve(gram + alpha * np.eye(len(gram)), rhs)
    else:
        beta = np.linalg.lstsq(gram, rhs, rcond=1e-12)[0]
    beta = beta / scale[:, None]
    return beta, ymean - mean @ beta


def loo_table(frame: DataFrame, by: FoldMoments, centre: np.ndarray, folds: Sequence[int], targets: Sequence[int], alphas: Sequence[float] = ALPHAS, standardise: bool = True) -> dict[tuple[int, int], np.ndarray]:
    """Mean squared leave-one-out errors of each fold's training rows at each penalty, by fold and target, in one pass.

    The error of a row is its residual over 1 - h, with h = 1/n + x'(G + a I)^-1 x for centred, scaled x. Targets
    with the same missing rows share a decomposition.
    """
    plans = []
    for k in folds:
        for ts in by.alike(targets):
            m = training_moments(by, k, ts[0])
            if m is None or m.n < MIN_TRAIN:
                continue
            mean = m.sx / m.n
            cov = m.xx / m.n - np.outer(mean, mean)
            scale = np.sqrt(np.clip(np.diag(cov), 0, None)) if standardise else np.ones(len(mean))
            scale = np.where(scale > 1e-12, scale, 1.0)
            values, vectors = np.linalg.eigh(m.n * cov / np.outer(scale, scale))
            ymean = m.sy[ts] / m.n
            rhs = vectors.T @ ((m.xy[:, ts] - np.outer(m.sx, ymean)) / scale[:, None])
            plans.append((k, ts, m.n, mean + centre, scale, np.clip(values, 0, None), vectors, rhs, ymean))
    grid = np.array(alphas)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = [np.zeros((len(p[1]), len(grid))) for p in plans]
        for b in batches:
            x, y, fold = _matrix(b.column("x")), _matrix(b.column("y")), b.column("fold").to_numpy()
            for total, (k, ts, n, mean, scale, values, vectors, rhs, ymean) in zip(sums, plans, strict=True):
                at = (fold != k) & ~np.isnan(y[:, ts[0]])
                u, own = ((x[at] - mean) / scale) @ vectors, y[at][:, ts]
                for j, a in enumerate(grid):
                    inv = 1 / (values + a)
                    rest = own - ymean - u @ (rhs * inv[:, None])
                    total[:, j] += ((rest / (1 - 1 / n - (u**2) @ inv)[:, None]) ** 2).sum(0)
        blocks = [(i, j, block) for i, total in enumerate(sums) for j, block in enumerate(cut(total))]
        me = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"plan": [i for i, _, _ in blocks], "number": [j for _, j, _ in blocks], "part": [me] * len(blocks), "block": [x for _, _, x in blocks]}, schema=pa.schema([("plan", pa.int64()), ("number", pa.int64()), ("part", pa.int64()), ("block", pa.binary())]))

    rows = frame.select(F.col("fold").cast("long").alias("fold"), "x", "y")
    blocks: dict[int, dict[int, bytes]] = {}
    summed = tree_sum(rows.mapInArrow(part, "plan long, number long, part long, block binary"), ["plan", "number"], by.n_parts).toLocalIterator() if plans else ()
    for r in summed:
        blocks.setdefault(r["plan"], {})[r["number"]] = bytes(r["block"])
    out = [joined([own[j] for j in sorted(own)]).reshape(-1, len(grid)) if (own := blocks.get(i)) else np.zeros((len(p[1]), len(grid))) for i, p in enumerate(plans)]
    return {(p[0], t): e / p[2] for p, table in zip(plans, out, strict=True) for t, e in zip(p[1], table, strict=True)}


def loo_errors(frame: DataFrame, by: FoldMoments, centre: np.ndarray, folds: Sequence[int], target: int = 0, alphas: Sequence[float] = ALPHAS, standardise: bool = True) -> dict[int, np.ndarray]:
    """:func:`loo_table` of one target, by fold."""
    return {k: e for (k, _), e in loo_table(frame, by, centre, folds, [target], alphas, standardise).items()}


def select_alphas(frame: DataFrame, by: FoldMoments, centre: np.ndarray, folds: Sequence[int], target: int = 0, alphas: Sequence[float] = ALPHAS) -> dict[int, float]:
    """The penalty with the least leave-one-out error of each fold; folds with fewer than 20 rows are left out."""
    few = {k for k in folds if (m := training_moments(by, k, target)) is None or m.n < 20}
    errors = loo_errors(frame, by, centre, [k for k in folds if k not in few], target, alphas)
    return {k: float(alphas[int(e.argmin())]) for k, e in errors.items()}


def choose_penalties(frame: DataFrame, n_folds: int, target: int = 0, alphas: Sequence[float] = ALPHAS) -> dict[int, float]:
    """:func:`select_alphas` of a frame whose features may be missing: these take the medians of a fold's training
    rows that have the target, so a pass is made for each fold; without missing features one serves all."""
    known = F.get("y", F.lit(target)).isNotNull() & ~F.isnan(F.get("y", F.lit(target)))
    if not has_missing(frame):
        centre = feature_means(frame)
        return select_alphas(frame, moments(frame, centre), centre, range(n_folds), target, alphas)
    out: dict[int, float] = {}
    for k in range(n_folds):
        own = [r["median"] for r in impute_medians(frame.filter((F.col("fold") != k) & known)).orderBy("pos").collect()]
        filled = fill(frame, own)
        centre = feature_means(filled)
        out |= select_alphas(filled, moments(filled, centre), centre, [k], target, alphas)
    return out


def choose_all_penalties(frame: DataFrame, n_folds: int, n_targets: int, alphas: Sequence[float] = ALPHAS) -> dict[tuple[int, int], float]:
    """:func:`choose_penalties` of all targets, by fold and target: one pass for sums and one for errors. With missing features, whose medians
    follow a target's rows, two for each fold and class of targets."""
    out: dict[tuple[int, int], float] = {}

    classes, n_parts = target_classes(frame), count_parts(frame)

    def chosen(rows: DataFrame, folds: Sequence[int], targets: Sequence[int]) -> None:
        centre = feature_means(rows)
        by = moments(rows, centre, classes, n_parts)
        enough = [(k, t) for k in folds for t in targets if (m := by.training(k, t)) is not None and m.n >= 20]
        errors = loo_table(rows, by, centre, folds, targets, alphas)
        out.update({kt: float(alphas[int(errors[kt].argmin())]) for kt in enough})

    if not has_missing(frame):
        chosen(frame, range(n_folds), range(n_targets))
        return out
    for c in np.unique(classes).tolist():
        own = np.flatnonzero(classes == c).tolist()
        known = F.get("y", F.lit(own[0])).isNotNull() & ~F.isnan(F.get("y", F.lit(own[0])))
        for k in range(n_folds):
            medians = [r["median"] for r in impute_medians(frame.filter((F.col("fold") != k) & known)).orderBy("pos").collect()]
            chosen(fill(frame, medians), [k], own)
    return out


def penalty_of(alpha: float | dict, fold: int, target: int) -> float | None:
    """The penalty of a fold and target from one for all, one for each fold or one for each fold and target."""
    if not isinstance(alpha, dict):
        return alpha
    return alpha.get((fold, target), alpha.get(fold))


def _prediction_sums(out: np.ndarray, by: FoldMoments, fold: int, alpha: float | dict) -> None:
    """Adds to rows, sums of y, y^2, predictions p, p^2 and y p, by target, those of a fold predicted from the others.

    Predictions are linear in the features, so these sums follow from the fold's own moments and no row is predicted.
    """
    for ts in by.alike(range(len(out))):
        m, own = by.training(fold, ts[0]), by.own(fold, ts[0])
        ts = [t for t in ts if penalty_of(alpha, fold, t) is not None]
        if m is None or own is None or m.n < MIN_TRAIN or not ts:
            continue
        mean, ymean = m.sx / m.n, m.sy[ts] / m.n
        cov = m.xx / m.n - np.outer(mean, mean)
        scale = np.sqrt(np.clip(np.diag(cov), 0, None))
        scale = np.where(scale > 1e-12, scale, 1.0)
        values, vectors = np.linalg.eigh(m.n * cov / np.outer(scale, scale))
        below = np.clip(values, 0, None)[:, None] + np.array([penalty_of(alpha, fold, t) for t in ts])
        rhs = vectors.T @ ((m.xy[:, ts] - np.outer(m.sx, ymean)) / scale[:, None])
        beta = vectors @ np.where(below > 1e-12 * max(values[-1], 1e-300), rhs / np.where(below > 0, below, 1.0), 0.0) / scale[:, None]
        shift = own.sx - own.n * mean
        spread = own.xx - np.outer(mean, own.sx) - np.outer(own.sx, mean) + own.n * np.outer(mean, mean)
        line = beta.T @ shift
        square = (beta * (spread @ beta)).sum(0)
        cross = (beta * (own.xy[:, ts] - np.outer(mean, own.sy[ts]))).sum(0)
        out[ts] += np.column_stack([np.full(len(ts), own.n), own.sy[ts], own.yy[ts], line + own.n * ymean, square + 2 * ymean * line + own.n * ymean**2, cross + ymean * own.sy[ts]])


def out_of_fold_correlations(frame: DataFrame, n_folds: int, n_targets: int, alpha: float | dict) -> list[tuple[float | None, int]]:
    """Correlation of each target with its out-of-fold predictions at given penalties, and the rows it is over.

    One scan (with missing features one for each fold) of as many targets as TARGET_BYTES of sums hold; no row is predicted.
    """
    missing, p = has_missing(frame), len(feature_means(frame))
    medians = fold_medians(frame, n_folds) if missing else None
    at_once = max(1, TARGET_BYTES // (8 * (p + 2) * n_folds))
    classes, n_parts, out = target_classes(frame), count_parts(frame), []
    for first in range(0, n_targets, at_once):
        n = min(at_once, n_targets - first)
        some = frame if n == n_targets else frame.withColumn("y", F.slice("y", first + 1, n))
        given = {(k, t): a for k in range(n_folds) for t in range(n) if (a := penalty_of(alpha, k, first + t)) is not None}
        sums = np.zeros((n, 6))
        for only in range(n_folds) if missing else [None]:
            rows = some if only is None else fill(some, medians[only])
            by = moments(rows, feature_means(rows), classes[first : first + n], n_parts)
            for k in range(n_folds) if only is None else [only]:
                _prediction_sums(sums, by, k, given)
        for rows_, y, yy, q, qq, yq in sums:
            below = (yy - y * y / max(rows_, 1)) * (qq - q * q / max(rows_, 1))
            out.append((float((yq - y * q / rows_) / below**0.5) if below > 0 else None, int(rows_)))
    return out


def alpha_margin(errors: dict[int, np.ndarray], alphas: Sequence[float] = ALPHAS) -> dict[int, tuple[float, float, float]]:
    """Best and second-best penalty of each fold and the relative gap of their errors."""
    out = {}
    for k, e in errors.items():
        first, second = np.argsort(e, kind="stable")[:2]
        out[k] = (float(alphas[first]), float(alphas[second]), float(e[second] / e[first] - 1))
    return out


def cross_val_predict(frame: DataFrame, targets: Sequence[str], n_folds: int, alpha: float | dict | None = None, alphas: Sequence[float] = ALPHAS, standardise: bool = True) -> DataFrame:
    """Out-of-fold predictions ``key, fold, target, y_true, y_pred``.

    alpha: one penalty, one for each fold, or fold and target's place, or None to choose by leave-one-out error for each.
    Missing features take the training medians of the fold. Targets with missing values are fitted on the rows
    that have them; folds with fewer than 10 training rows give no predictions for a target.
    """
    missing = has_missing(frame)
    folds = list(range(n_folds))
    passes = folds if missing else [None]
    medians = fold_medians(frame, n_folds) if missing else None
    centre = feature_means(frame)
    p = len(centre)
    if not p:
        return frame.sparkSession.createDataFrame([], f"key {dict(frame.dtypes)['key']}, fold int, target string, y_true double, y_pred double")
    models: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    classes, n_parts = target_classes(frame), count_parts(frame)
    for only in passes:
        rows = frame
        if medians is not None:
            rows = fill(frame, medians[only])
        by = moments(rows, centre, classes, n_parts)
        errors = loo_table(rows, by, centre, folds if only is None else [only], range(len(targets)), alphas, standardise) if alpha is None else {}
        for k in folds if only is None else [only]:
            beta, icpt = np.full((p, len(targets)), np.nan), np.full(len(targets), np.nan)
            for ts in by.alike(range(len(targets))):  # targets with the same rows share a factorisation at a fixed penalty
                m = training_moments(by, k, ts[0])
                if m is None or m.n < MIN_TRAIN:
                    continue
                if alpha is not None:
                    shared: dict[float, list[int]] = {}
                    for t in ts:
                        if (a := penalty_of(alpha, k, t)) is not None:
                            shared.setdefault(a, []).append(t)
                    for a, own in shared.items():
                        beta[:, own], icpt[own] = solve(m, own, a, standardise)
                else:
                    for t in ts:
                        beta[:, [t]], icpt[[t]] = solve(m, [t], float(alphas[int(errors[k, t].argmin())]), standardise)
            models[k] = (beta, icpt - np.nan_to_num(centre) @ beta)
    names = list(targets)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, fold = _matrix(b.column("x")), _matrix(b.column("y")), b.column("fold").to_numpy()
            keys = b.column("key")
            for k, (beta, icpt) in models.items():
                at = np.flatnonzero(fold == k)
                if not len(at):
                    continue
                xs = x[at] if medians is None else np.where(np.isnan(x[at]), medians[k], x[at])
                pred = xs @ beta + icpt
                for t, name in enumerate(names):
                    ok = ~np.isnan(y[at, t]) & ~np.isnan(pred[:, t])
                    rows = at[ok]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(np.full(len(rows), k, np.int32)), pa.array([name] * len(rows), pa.string()), pa.array(y[rows, t]), pa.array(pred[ok, t])], ["key", "fold", "target", "y_true", "y_pred"])

    kind = dict(frame.dtypes)["key"]
    return frame.select("key", F.col("fold").cast("int").alias("fold"), "x", "y").mapInArrow(apply, f"key {kind}, fold int, target string, y_true double, y_pred double")
