"""Bootstrap by weights: each replicate is a weight for every cluster, and moments of all replicates add up in one pass."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import boundaries, rank_in_order, with_average_rank
from ..functions.stats import pearson

MIN_ROWS = 20
MIN_DRAWS = 20
MIN_NULLS = 5
#: Null draws of a set that the interval of the pooled bootstrap uses at most; its value comes from all of them.
MAX_NULLS = 200


def cluster_sums(frame: DataFrame, cluster: str, values: Sequence[str]) -> DataFrame:
    """``cluster, n, sums``: all that a bootstrap over clusters needs of the rows."""
    return frame.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values))


def resample(clusters: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """``replicate, w`` and the columns of clusters: how often each cluster is drawn in each replicate.

    Draw i of replicate b takes the cluster at place h mod G, h from the first 8 digits of md5("seed|b|i"), so
    any engine with md5 gives the same draws. Places follow the cluster order. Draws are many and clusters one row each, so
    clusters are the side that a join builds, whatever the estimates say.
    """
    g = clusters.count()
    draws = clusters.sparkSession.range(g).select(F.col("id").alias("i"), F.lit(g).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("replicate"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    hits = draws.select("replicate", F.pmod(h, F.col("g")).alias("place")).groupBy("replicate", "place").agg(F.count("*").alias("w"))
    return hits.join(rank_in_order(clusters, "cluster").hint("shuffle_hash"), "place").select("replicate", "w", *clusters.columns)


def paired_delta(frame: DataFrame, a: str, b: str, cluster: str, n_boot: int = 2000, seed: int = 0, alpha: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """``value, lo, hi, n``: mean of a - b with a percentile interval over resampled clusters; n counts clusters."""
    d = frame.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_d", F.col(a) - F.col(b))
    sums = cluster_sums(d, cluster, ["_d"])
    point = sums.agg((F.sum("_d") / F.sum("n")).alias("value"), F.count("*").alias("n"), F.lit(1).alias("_one"))
    reps = resample(sums, n_boot, seed).groupBy("replicate").agg((F.sum(F.col("w") * F.col("_d")) / F.sum(F.col("w") * F.col("n"))).alias("v"))
    ends = reps.agg(F.percentile("v", F.lit(alpha / 2)).alias("lo"), F.percentile("v", F.lit(1 - alpha / 2)).alias("hi"), F.lit(1).alias("_one"))
    return point.join(F.broadcast(ends), "_one").select("value", "lo", "hi", "n")  # one row each


def bootstrap_corr(frame: DataFrame, x: str, y: str, cluster: str, n_boot: int = 2000, seed: int = 0, alpha: float = 0.05, method: str = "pearson") -> DataFrame:
    """``value, lo, hi, n``: correlation with a percentile interval over resampled clusters.

    Pearson replicates come from weighted moments of the clusters. Spearman replicates need ranks of their own:
    each replicate's weighted rows are ranked by it in ranges of the value, with w copies of a row sharing ranks.
    """
    ok = frame.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if method == "pearson":
        centre = ok.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.lit(1).alias("_one"))
        c = ok.withColumn("_one", F.lit(1)).join(F.broadcast(centre), "_one").withColumn("_x", F.col(x) - F.col("mx")).withColumn("_y", F.col(y) - F.col("my"))
        c = c.withColumns({"_xx": F.col("_x") * F.col("_x"), "_yy": F.col("_y") * F.col("_y"), "_xy": F.col("_x") * F.col("_y")})
        sums = cluster_sums(c, cluster, ["_x", "_y", "_xx", "_yy", "_xy"])
        s = {k: F.sum(F.col("w") * F.col(k)) for k in ("n", "_x", "_y", "_xx", "_yy", "_xy")}
        r = F.try_divide(s["_xy"] - s["_x"] * s["_y"] / s["n"], F.sqrt((s["_xx"] - s["_x"] * s["_x"] / s["n"]) * (s["_yy"] - s["_y"] * s["_y"] / s["n"])))
        reps = resample(sums, n_boot, seed).groupBy("replicate").agg(r.alias("v"))
        point = ok.agg(pearson(F.col(x), F.col(y)).alias("value"), F.countDistinct(cluster).alias("n"), F.lit(1).alias("_one"))
    else:
        sums = cluster_sums(ok, cluster, [])
        values = ok.select(F.col(cluster).alias("cluster"), F.col(x).alias("_x"), F.col(y).alias("_y"))
        cuts = {c: boundaries(values, c) for c in ("_x", "_y")}
        rep = resample(sums, n_boot, seed).drop("n").join(values, "cluster").select("replicate", "w", "_x", "_y")
        for c in ("_x", "_y"):
            rep = with_average_rank(rep, c, f"r{c}", ["replicate"], "w", cuts[c])
        n, mx, my = F.sum("w"), F.sum(F.col("w") * F.col("r_x")), F.sum(F.col("w") * F.col("r_y"))
        prod = lambda a, b: F.sum(F.col("w") * F.col(a) * F.col(b))
        r = F.try_divide(prod("r_x", "r_y") - mx * my / n, F.sqrt((prod("r_x", "r_x") - mx * mx / n) * (prod("r_y", "r_y") - my * my / n)))
        reps = rep.groupBy("replicate").agg(r.alias("v"))
        ranked = values
        for c in ("_x", "_y"):
            ranked = with_average_rank(ranked, c, f"r{c}", cuts=cuts[c])
        point = ranked.agg(pearson(F.col("r_x"), F.col("r_y")).alias("value"), F.countDistinct("cluster").alias("n"), F.lit(1).alias("_one"))
    ends = reps.agg(F.percentile("v", F.lit(alpha / 2)).alias("lo"), F.percentile("v", F.lit(1 - alpha / 2)).alias("hi"), F.lit(1).alias("_one"))
    return point.join(F.broadcast(ends), "_one").select("value", "lo", "hi", "n")  # one row each


def poisson_weights(rows: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """Counts (replicates x rows) of a Poisson bootstrap; replicate 0 takes every row once.

    A count depends on the seed, the replicate and the row's 64-bit hash alone, so a task needs its own rows only.
    """
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64)[None, :] + (np.arange(n_boot + 1, dtype=np.uint64)[:, None] + np.uint64((seed * 1_000_003) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    w = np.searchsorted(steps, u, side="right").astype(float)
    w[0] = 1.0
    return w


def pooled_bootstrap(frame: DataFrame, alphas: dict[str, tuple[float | None, Sequence[float | None]]], n_boot: int = 1000, seed: int = 0, alpha: float = 0.05, point: dict[str, float] | None = None) -> dict[str, float]:
    """Pooled index with a patient bootstrap: value, lo, hi, n, n_rows, n_dropped, n_draws.

    frame: ``key, sets array<array<double>>`` with, for each set in the order of ``alphas``, alternating truth and
    prediction of the observed score and then of each null draw. alphas: for each set the reliability of the observed
    score and of each draw; all null for a set that isn't disattenuated. A set's index is z(r / sqrt(a)) of the
    observed minus the mean over draws; sets need MIN_NULLS draws.

    The value is the mean of ``point`` (of the sets' indices over all draws) and n their number; without it, the
    frame's own indices count. The interval comes from replicates that share one resample of the rows; rows with a
    value missing anywhere take no part in them. Sums add up on executors, one row for each replicate and set.
    """
    names = list(alphas)
    whole = frame.select("key", "sets", F.exists("sets", lambda s: F.exists(s, lambda v: v.isNull() | F.isnan(v))).alias("bad"))
    size = whole.agg(F.count_if(~F.col("bad")).alias("n"), F.count_if("bad").alias("dropped")).first()
    n, none = size["n"], {"lo": math.nan, "hi": math.nan, "n_rows": size["n"], "n_dropped": size["dropped"], "n_draws": 0}
    given = [v for v in (point or {}).values() if v is not None and math.isfinite(v)]
    own_value = {"value": sum(given) / len(given) if given else math.nan, "n": len(given)}
    if n < MIN_ROWS:
        return own_value | none
    chunk = 64
    one_nan = lambda x: math.nan if x is None else float(x)
    rel = [None if own is None else np.array([one_nan(own), *map(one_nan, null)]) for own, null in alphas.values()]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: list[np.ndarray] | None = None
        for b in batches:
            rows = b.column("sets").to_pylist()
            for at in range(0, len(rows), 2000):
                some = rows[at : at + 2000]
                w = poisson_weights(b.column("h").to_numpy()[at : at + 2000], n_boot, seed)
                if acc is None:
                    acc = [np.zeros((n_boot + 1, len(x) // 2, 6)) for x in some[0]]
                for k in range(len(names)):
                    m = np.array([r[k] for r in some])
                    t, p = m[:, ::2], m[:, 1::2]
                    for j, q in enumerate((t, p, t * t, p * p, t * p)):
                        acc[k][:, :, j] += w @ q
                    acc[k][:, :, 5] += w.sum(1)[:, None]
        for k, a in enumerate(acc or []):
            for c in range(0, n_boot + 1, chunk):
                yield pa.RecordBatch.from_pydict({"k": [k], "chunk": [c], "m": [a[c : c + chunk].tobytes()]}, schema=pa.schema([("k", pa.int64()), ("chunk", pa.int64()), ("m", pa.binary())]))

    def index(table: pa.Table) -> pa.Table:
        k, first = table["k"][0].as_py(), table["chunk"][0].as_py()
        s = sum(np.frombuffer(x) for x in table["m"].to_pylist()).reshape(min(chunk, n_boot + 1 - first), -1, 6)
        with np.errstate(invalid="ignore", divide="ignore"):
            size = s[..., 5]
            r = (s[..., 4] - s[..., 0] * s[..., 1] / size) / np.sqrt((s[..., 2] - s[..., 0] ** 2 / size) * (s[..., 3] - s[..., 1] ** 2 / size))
            if rel[k] is not None:
                r = np.where(rel[k] > 0.01, r / np.sqrt(rel[k]), np.nan)
                r = np.where(np.abs(r) < 1, r, np.nan)
            z = np.arctanh(np.clip(r, -0.999999, 0.999999))
            many = np.isfinite(z[:, 1:]).sum(1)
            value = np.where(many >= MIN_NULLS, z[:, 0] - np.nansum(z[:, 1:], 1) / np.maximum(many, 1), np.nan)
        at = np.flatnonzero(np.isfinite(value))
        return pa.table({"k": pa.array(np.full(len(at), k)), "replicate": pa.array(first + at), "index": pa.array(value[at])})

    parts = whole.filter(~F.col("bad")).select(F.xxhash64("key").alias("h"), "sets").mapInArrow(part, "k long, chunk long, m binary")
    found = parts.groupBy("k", "chunk").applyInArrow(index, "k long, replicate long, index double")
    by = found.groupBy("replicate").agg(F.avg("index").alias("v"), F.count("*").alias("sets"))
    draw = F.when(F.col("replicate") > 0, F.col("v"))
    r = by.agg(F.max(F.when(F.col("replicate") == 0, F.col("v"))).alias("v"), F.max(F.when(F.col("replicate") == 0, F.col("sets"))).alias("sets"), F.percentile(draw, F.lit(alpha / 2)).alias("lo"), F.percentile(draw, F.lit(1 - alpha / 2)).alias("hi"), F.count(draw).alias("n_draws")).first()
    if point is None:
        own_value = {"value": one_nan(r["v"]), "n": r["sets"] or 0}
    enough = r["n_draws"] >= MIN_DRAWS
    return own_value | none | {"lo": r["lo"] if enough else math.nan, "hi": r["hi"] if enough else math.nan, "n_draws": r["n_draws"]}


def effective_tests(correlations: np.ndarray) -> float:
    """Li and Ji's number of independent tests from a correlation matrix's eigenvalues."""
    c = np.asarray(correlations, float)
    if c.ndim != 2 or c.shape[0] != c.shape[1] or not np.isfinite(c).all():
        raise ValueError("a full square matrix is needed")
    e = np.clip(np.linalg.eigvalsh((c + c.T) / 2), 0, None)
    return float(np.sum((e >= 1) + (e - np.floor(e))))


def correlation_matrix(scores: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and correlations of sets over samples, from ``sample, set_name, score``: one aggregate over pairs of sets."""
    a, b = scores.alias("a"), scores.alias("b")
    pairs = a.join(b, (F.col("a.sample") == F.col("b.sample")) & (F.col("a.set_name") <= F.col("b.set_name")))
    rows = pairs.groupBy(F.col("a.set_name").alias("x"), F.col("b.set_name").alias("y")).agg(pearson(F.col("a.score"), F.col("b.score")).alias("r")).collect()
    names = sorted({r["x"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names))
    for r in rows:
        m[at[r["x"]], at[r["y"]]] = m[at[r["y"]], at[r["x"]]] = r["r"]
    return names, m


def summarise(estimates: dict[str, dict[str, float]]) -> pd.DataFrame:
    """A tidy table of named estimates."""
    return pd.DataFrame([{"name": k, **v} for k, v in estimates.items()])
