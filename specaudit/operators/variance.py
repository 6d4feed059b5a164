"""How much of a score's variance sites, types, purity and a prediction explain."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson
from .groups import permuted_cells


def single_factor_r2(frame: DataFrame, y: str, factor: str, keys: Sequence[str] = ()) -> DataFrame:
    """``n, levels, r2, adj_r2`` (by keys) of a one-factor model: between over total sum of squares.

    Group sums are enough, so dummies never exist. Null for n <= levels.
    """
    k = list(keys)
    ok = frame.filter(F.col(y).isNotNull() & ~F.isnan(y) & F.col(factor).isNotNull())
    mean = ok.groupBy(*k).agg(F.avg(y).alias("_m"))
    centred = ok.join(mean, k) if k else ok.join(F.broadcast(mean.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))  # one row
    d = F.col(y) - F.col("_m")
    cells = centred.groupBy(*k, factor).agg(F.count("*").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"))
    g = cells.groupBy(*k).agg(F.sum("n").alias("n"), F.count("*").alias("levels"), F.try_divide(F.sum(F.col("s") * F.col("s") / F.col("n")), F.sum("ss")).alias("r2"))
    r2 = F.when(F.col("n") > F.col("levels"), F.col("r2"))
    return g.select(*k, "n", "levels", r2.alias("r2"), (1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - F.col("levels"))).alias("adj_r2"))


def _design(frame: DataFrame, terms: Sequence[str], categorical: Sequence[str]) -> tuple[list[str], dict[str, list]]:
    """Names of the design's columns and the levels of its factors (missing is a level of its own, the first is left out)."""
    levels = {t: sorted((r[0] for r in frame.select(t).distinct().collect()), key=lambda v: (v is None, str(v))) for t in terms if t in categorical}
    names = [f"{t}={v}" for t in terms if t in categorical for v in levels[t][1:]] + [t for t in terms if t not in categorical]
    return names, levels


def gram(frame: DataFrame, terms: Sequence[str], categorical: Sequence[str], targets: Sequence[str]) -> tuple[np.ndarray, list[str], dict[str, slice | list[int]]]:
    """Cross products of intercept, dummies, numbers and targets; columns follow terms, then targets.

    Each Arrow batch adds its own; the driver adds partitions. The design has as many columns as factor levels.
    """
    names, levels = _design(frame, terms, categorical)
    width = 1 + len(names) + len(targets)
    place: dict[str, list[int]] = {}
    at = 1
    for t in terms:
        if t in categorical:
            place[t] = list(range(at, at + len(levels[t]) - 1))
            at += len(levels[t]) - 1
    for t in terms:
        if t not in categorical:
            place[t] = [at]
            at += 1
    place.update({t: [at + i] for i, t in enumerate(targets)})
    code = {t: {v: i for i, v in enumerate(levels[t])} for t in levels}

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = np.zeros((b.num_rows, width))
            x[:, 0] = 1
            for t in terms:
                if t in categorical:
                    c = np.array([code[t][v] for v in b.column(t).to_pylist()])
                    on = np.flatnonzero(c > 0)
                    x[on, place[t][0] + c[on] - 1 if len(place[t]) else 0] = 1
                else:
                    x[:, place[t][0]] = b.column(t).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for t in targets:
                x[:, place[t][0]] = b.column(t).cast(pa.float64()).to_numpy(zero_copy_only=False)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

    out = np.zeros((width, width))
    for r in frame.select(*terms, *targets).mapInArrow(part, "g array<double>").toLocalIterator():
        out += np.array(r["g"]).reshape(width, width)
    return out, names, place


@dataclass
class Sums:
    """Sparse cross products of factors, numbers and targets about the numbers' means: counts of the pairs of levels that occur, sums by level."""

    n: int
    centre: dict[str, float]
    levels: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]]
    by_level: dict[tuple[str, str], np.ndarray]
    dense: dict[tuple[str, str], float]

    def number(self, a: str, b: str) -> float:
        return self.dense[(a, b) if (a, b) in self.dense else (b, a)]

    def r2(self, terms: Sequence[str], target: str, tol: float = 1e-10, max_iter: int = 5000) -> tuple[float, float, int]:
        """R2, adjusted R2 and the number of parameters of least squares of a target on terms.

        Numbers without variance don't count as parameters; NaN for as many parameters as rows. By conjugate gradients on all levels of the factors, scaled by their counts; a product costs as much as there are pairs of levels. That the
        levels of a factor add up to the intercept, or to a coarser factor, leaves the fitted values as they are.
        """
        factors, numbers = [t for t in terms if t in self.levels], [t for t in terms if t not in self.levels]
        numbers = [t for t in numbers if self.number(t, t) > 1e-10 * max(1.0, self.number(t, t) + self.n * self.centre[t] ** 2)]
        total = self.number(target, target)
        p = 1 + len(numbers) + sum(len(self.levels[f]) - 1 for f in factors)
        if self.n <= p or total <= 0:
            return np.nan, np.nan, p
        if p == 1:
            return 0.0, 0.0, p
        at, end = {}, 0
        for f in factors:
            at[f] = slice(end, end + len(self.levels[f]))
            end += len(self.levels[f])
        for t in numbers:
            at[t] = slice(end, end + 1)
            end += 1
        means = np.concatenate([*(self.levels[f] / self.n for f in factors), np.zeros(len(numbers))])
        diagonal = np.concatenate([*(self.levels[f] * (1 - self.levels[f] / self.n) for f in factors), [self.number(t, t) for t in numbers]])
        scale = 1 / np.sqrt(np.where(diagonal > 1e-9, diagonal, 1.0))
        # about the mean to the last digit: what the sums of a factor's levels are off by lies where no solution does
        rhs = np.concatenate([*(self.by_level[f, target] - self.levels[f] * (self.by_level[f, target].sum() / self.n) for f in factors), [self.number(t, target) for t in numbers]])

        def product(v: np.ndarray) -> np.ndarray:
            out = np.zeros(len(v))
            for i, f in enumerate(factors):
                out[at[f]] += self.levels[f] * v[at[f]]
                for g in factors[i + 1 :]:
                    a, b, c = self.pairs[(f, g) if (f, g) in self.pairs else (g, f)]
                    a, b = (a, b) if (f, g) in self.pairs else (b, a)
                    out[at[f]] += np.bincount(a, c * v[at[g]][b], len(self.levels[f]))
                    out[at[g]] += np.bincount(b, c * v[at[f]][a], len(self.levels[g]))
                for t in numbers:
                    out[at[f]] += self.by_level[f, t] * v[at[t]]
                    out[at[t]] += self.by_level[f, t] @ v[at[f]]
            for t in numbers:
                for u in numbers:
                    out[at[t]] += self.number(t, u) * v[at[u]]
            return out - self.n * means * (means @ v)

        b = scale * rhs
        beta, rest = np.zeros(len(b)), b.copy()
        way, size = rest.copy(), rest @ rest
        best, since = (size, beta), 0
        for _ in range(max_iter):
            if size <= tol**2 * (b @ b) or since > 50:  # rounding is all that is left
                break
            step = scale * product(scale * way)
            if (curve := way @ step) <= 0:
                break
            beta, rest = beta + size / curve * way, rest - size / curve * step
            new = rest @ rest
            way, size = rest + new / size * way, new
            best, since = ((size, beta), 0) if size < best[0] else (best, since + 1)
        r2 = float(np.clip(b @ best[1] / total, 0.0, 1.0))
        return r2, float(1 - (1 - r2) * (self.n - 1) / (self.n - p)), p


def sums(frame: DataFrame, terms: Sequence[str], categorical: Sequence[str], targets: Sequence[str]) -> Sums:
    """:class:`Sums` of a frame without missing numbers; a missing level is a level of its own.

    All by partial aggregates: one over numbers, one for each factor, one for each pair of factors. Levels, and the pairs that
    occur, come to the driver; dummies exist nowhere.
    """
    factors, numbers = [t for t in terms if t in categorical], list(dict.fromkeys([*(t for t in terms if t not in categorical), *targets]))
    means = frame.agg(F.count("*").alias("n"), *(F.avg(F.col(c).cast("double")).alias(c) for c in numbers)).first()
    centred = frame.select(*factors, *((F.col(c).cast("double") - F.lit(means[c] or 0.0)).alias(c) for c in numbers))
    cells = [(a, b) for i, a in enumerate(numbers) for b in numbers[i:]]
    row = centred.agg(*(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"{i}") for i, (a, b) in enumerate(cells))).first() if cells else ()
    dense = dict(zip(cells, row, strict=True))
    code, levels, by_level, pairs = {}, {}, {}, {}
    for f in factors:
        found = centred.groupBy(f).agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{i}") for i, c in enumerate(numbers))).collect()
        code[f] = {r[f]: i for i, r in enumerate(found)}
        levels[f] = np.array([r["_n"] for r in found], float)
        by_level |= {(f, c): np.array([r[f"_{i}"] for r in found]) for i, c in enumerate(numbers)}
    for i, f in enumerate(factors):
        for g in factors[i + 1 :]:
            found = frame.groupBy(F.col(f).alias("a"), F.col(g).alias("b")).agg(F.count("*").alias("n")).collect()
            pairs[f, g] = np.array([code[f][r["a"]] for r in found], np.int64), np.array([code[g][r["b"]] for r in found], np.int64), np.array([r["n"] for r in found], float)
    return Sums(means["n"], {c: means[c] or 0.0 for c in numbers}, levels, pairs, by_level, dense)


def complete(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value in any of the columns: one mask for a whole ladder."""
    kinds = dict(frame.dtypes)
    for c in columns:
        frame = frame.filter(F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)))
    return frame


def r2_ladder(frame: DataFrame, score: str, prediction: str, rungs: Sequence[tuple[str, Sequence[str]]], categorical: Sequence[str]) -> pd.DataFrame:
    """``model, n, r2, adj_r2, delta_r2`` of nested models on one mask, with the prediction added last and alone.

    One set of sums serves all rungs. The prediction's increment is the last difference of adjusted R2.
    """
    terms = list(dict.fromkeys(t for _, ts in rungs for t in ts))
    return _rungs(sums(complete(frame, [score, prediction, *terms]), [*terms, prediction], categorical, [score]), score, prediction, rungs)


def _rungs(g: Sums, score: str, prediction: str, rungs: Sequence[tuple[str, Sequence[str]]]) -> pd.DataFrame:
    terms = list(dict.fromkeys(t for _, ts in rungs for t in ts))
    rows, before = [], 0.0
    for name, ts in [*rungs, ("Mfull", [*terms, prediction]), ("Image_only", [prediction])]:
        r2, adj, _ = g.r2(ts, score)
        rows.append({"model": name, "n": g.n, "r2": r2, "adj_r2": adj, "delta_r2": r2 - before if name != "Image_only" else np.nan})
        before = r2
    return pd.DataFrame(rows)


def incremental_r2(ladder: pd.DataFrame) -> float:
    full = ladder.index[ladder["model"] == "Mfull"][0]
    return float(ladder["adj_r2"].iloc[full] - ladder["adj_r2"].iloc[full - 1])


def decompose_all(frame: DataFrame, pairs: Sequence[tuple[str, str]], rungs: Sequence[tuple[str, Sequence[str]]], categorical: Sequence[str]) -> pd.DataFrame:
    """Ladders of several (score, prediction) pairs, wide by model, largest increment first.

    Pairs that are complete in the same rows, as many as there are, share one set of sums.
    """
    terms = list(dict.fromkeys(t for _, ts in rungs for t in ts))
    known = lambda *cs: F.lit(True) if not cs else functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cs))
    base = complete(frame, terms)
    here = [known(s, p) for s, p in pairs]
    whole = F.sum(functools.reduce(lambda a, b: a & b, here).cast("long")) if pairs else F.lit(0)
    counts = base.agg(whole.alias("all"), *(F.sum(h.cast("long")).alias(f"_{i}") for i, h in enumerate(here))).first()
    alike = [(s, p) for i, (s, p) in enumerate(pairs) if counts[f"_{i}"] == counts["all"]]
    both = list(dict.fromkeys(c for pair in alike for c in pair))
    shared = sums(complete(base, list(dict.fromkeys(c for pair in pairs for c in pair))), [*terms, *both], categorical, both) if alike else None
    out = []
    for score, prediction in pairs:
        ladder = _rungs(shared, score, prediction, rungs) if (score, prediction) in alike else r2_ladder(frame, score, prediction, rungs, categorical)
        out.append({"signature": score, "incremental_image_r2": incremental_r2(ladder), "n_ladder": int(ladder["n"].iloc[0]), **dict(zip(ladder["model"], ladder["r2"], strict=True))})
    return pd.DataFrame(out).sort_values("incremental_image_r2", ascending=False, ignore_index=True)


def label_site_variance(frame: DataFrame, scores: Sequence[str], site: str, kind: str | None = None, purity: str | None = None, plate: str | None = None, min_site_n: int = 10) -> pd.DataFrame:
    """R2 of site, type, site given type, plate within site and purity, without any prediction.

    Sites below min_site_n drop out; scores with fewer than 30 values are skipped; a plate column with fewer than
    two levels gives nulls. One mask over site, type and purity serves all models of a score.
    """
    big = frame.groupBy(site).agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_site_n).select(site)
    sub = frame.join(big, site, "left_semi")
    n_sites = big.count()
    if n_sites < 2:
        raise ValueError(f"{n_sites} sites have {min_site_n} rows")
    plates = sub.filter(F.col(plate).isNotNull()).select(plate).distinct().count() if plate else 0
    factors = [c for c in (site, kind) if c]
    rows = []
    for s in scores:
        ok = complete(sub, [s, *factors, *([purity] if purity else [])])
        if ok.count() < 30:
            continue
        terms = list(dict.fromkeys([*factors, *([plate] if plate and plates > 1 else []), *([purity] if purity else [])]))
        g = sums(ok, terms, [c for c in terms if c != purity], [s])
        r = lambda *ts: g.r2(ts, s)  # noqa: B023, E731
        row = {"signature": s, "n": g.n, "n_sites": n_sites, "r2_site_only": r(site)[0], "adj_r2_site_only": r(site)[1]}
        if kind:
            row |= {"r2_type_only": r(kind)[0], "r2_site_given_type": r(kind, site)[0] - r(kind)[0]}
        if plate:
            both = r(site, plate)[0] if plates > 1 else np.nan
            row |= {"r2_site_plus_plate": both, "r2_plate_within_site": both - row["r2_site_only"]}
        if purity:
            row["r2_purity_only"] = r(purity)[0]
        rows.append(row)
    out = pd.DataFrame(rows)
    return out.sort_values("r2_site_only", ascending=False, ignore_index=True) if len(out) else out


def purity_share(frame: DataFrame, score: str, prediction: str, purity: str, keys: Sequence[str] = (), min_n: int = 10) -> DataFrame:
    """``n_share, r_image, r_purity, r_partial`` over complete rows; the partial correlation from three plain ones."""
    ok = complete(frame, [score, prediction, purity])
    y, p, u = F.col(score), F.col(prediction), F.col(purity)
    g = ok.groupBy(*keys).agg(F.count("*").alias("n_share"), pearson(y, p).alias("_yp"), pearson(y, u).alias("_yu"), pearson(p, u).alias("_pu"))
    enough = F.col("n_share") >= min_n
    rest = F.sqrt(F.greatest((1 - F.col("_yu") * F.col("_yu")) * (1 - F.col("_pu") * F.col("_pu")), F.lit(0.0)))
    return g.select(*keys, "n_share", F.when(enough, F.col("_yp")).alias("r_image"), F.when(enough, F.col("_yu")).alias("r_purity"), F.when(enough, F.try_divide(F.col("_yp") - F.col("_yu") * F.col("_pu"), rest)).alias("r_partial"))


def permutation_calibration(frame: DataFrame, y: str, site: str, key: str, within: str | None = None, n_perm: int = 1000, seed: int = 0) -> DataFrame:
    """``r2, null_median, calibrated, perm_p``: site R2 against that of site labels dealt anew within types."""
    ok = complete(frame, [y, site, *([within] if within else [])])
    seen = single_factor_r2(ok, y, site).select("r2")
    # values stay with their rows, so their mean and total are those of all permutations
    s = ok.agg(F.avg(y).alias("m"), F.count("*").alias("n"), F.countDistinct(site).alias("levels")).first()
    centred = ok.withColumn("_d", F.col(y) - F.lit(s["m"]))
    total = centred.agg(F.sum(F.col("_d") * F.col("_d"))).first()[0]
    cells = permuted_cells(centred, key, site, n_perm, seed, within, value="_d")
    r2 = F.try_divide(F.sum(F.col("s") * F.col("s") / F.col("n")), F.lit(total))
    null = cells.groupBy("perm").agg((r2 if s["n"] > s["levels"] else F.lit(None).cast("double")).alias("nr2"))
    j = null.join(F.broadcast(seen.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"))  # one row
    g = j.agg(F.max("r2").alias("r2"), F.median("nr2").alias("null_median"), F.count_if(F.col("nr2") >= F.col("r2")).alias("ge"), F.count("nr2").alias("b"))
    return g.select("r2", "null_median", (F.col("r2") - F.col("null_median")).alias("calibrated"), ((1 + F.col("ge")) / (1.0 + F.col("b"))).alias("perm_p"))


def out_of_fold_r2(frame: DataFrame, score: str, terms: Sequence[str], categorical: Sequence[str], fold: str = "fold", n_folds: int = 5) -> float:
    """1 - residual over total sum of squares of out-of-fold least squares; from Gram matrices of the folds alone."""
    levels = _design(frame, terms, categorical)[1]
    full = frame.filter(F.col(score).isNotNull())
    for t in terms:
        if t not in categorical:
            full = full.withColumn(t, F.coalesce(F.when(~F.isnan(t), F.col(t)), F.lit(0.0)))
    grams = []
    for k in range(n_folds):
        own = full.filter(F.col(fold) == k)
        # every fold must use the levels of the whole table
        pad = frame.sparkSession.createDataFrame([tuple(levels[t][i % len(levels[t])] if t in levels else 0.0 for t in terms) + (0.0,) for i in range(max([1, *(len(v) for v in levels.values())]))], full.select(*terms, F.col(score).cast("double").alias(score)).schema)
        both = own.select(*terms, F.col(score).cast("double").alias(score))
        g, _, place = gram(both.unionByName(pad), terms, categorical, [score])
        p, _, _ = gram(pad, terms, categorical, [score])
        grams.append(g - p)
    total = sum(grams)
    target = place[score][0]
    cols = [0, *(c for t in terms for c in place[t])]
    rss = 0.0
    for g in grams:
        train = total - g
        beta = np.linalg.lstsq(train[np.ix_(cols, cols)], train[cols, target], rcond=1e-10)[0]
        rss += g[target, target] - 2 * beta @ g[cols, target] + beta @ g[np.ix_(cols, cols)] @ beta
    n = total[0, 0]
    return float(1 - rss / (total[target, target] - total[0, target] ** 2 / n))
