"""Clustering by ball k-means over integer vectors, exact in every step.

A cluster is a ball: a centroid and the distance of its farthest member. By the triangle inequality a member at distance d
from its ball's centroid can only be nearer to another centroid whose distance from that one is at most 2 d. So centroids
beyond twice the radius are no neighbours of the ball, members within half the distance of the nearest neighbour are its
stable core and are compared with nothing, and those in the annulus between half the distances of the a-th and the next
neighbour are compared with the first a alone. The ball that a vector is kept in need not be its present cluster for this to hold, so
rounds read one stored table and write none; it is written anew when many vectors have left their balls.

Balls are taken of the rows of an Arrow batch: their radii are smaller than those of all rows and exclude more. A round sends a
sum of vectors for each task and cluster through the shuffle, and k centroids to the driver and back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, release, small_batches

#: Share of the vectors outside their stored balls from which these are written anew.
MOVED = 0.25


def component_bound(dims: int) -> int:
    """The largest component for which four times a squared distance still fits in 64 bits."""
    return math.isqrt((1 << 60) // max(1, dims)) // 2


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id long, v array<int>``: floor(scale * x) of the components, as double, of vectors with exactly so many components, none null or
    non-finite; others are left out.

    Components beyond :func:`component_bound` are taken as that bound (for 64 and 1024, those of 65,536 and more), since a
    distance must fit in 64 bits. Null and repeated ids are kept.
    """
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(math.inf), F.lit(False)))  # NaN counts as greater than any
    bound = component_bound(dims)
    whole = F.transform(column, lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(bound)), F.lit(-bound)).cast("int"))
    return vectors.filter((F.size(column) == dims) & finite).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order; null ids count as empty, equal ids go by components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def between(centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs of centroids."""
    return ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)


def assign(x: np.ndarray, ball: np.ndarray, centroids: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (of equal ones the smallest number) and squared distance of each row, given the balls rows are kept in."""
    best = ((x - centroids[ball]) ** 2).sum(1)
    cluster = ball.copy()
    for b in np.unique(ball).tolist():
        rows = np.flatnonzero(ball == b)
        reach = 4 * best[rows]
        near = np.flatnonzero((apart[b] <= reach.max()) & (np.arange(len(centroids)) != b))
        near = near[np.argsort(apart[b][near], kind="stable")]
        annulus = np.searchsorted(apart[b][near], reach, side="right")
        for a, j in enumerate(near.tolist()):
            open_ = rows[annulus > a]
            d = ((x[open_] - centroids[j]) ** 2).sum(1)
            nearer = (d < best[open_]) | ((d == best[open_]) & (j < cluster[open_]))
            best[open_[nearer]], cluster[open_[nearer]] = d[nearer], j
    return cluster, best


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)


def _in_balls(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, v, ball``: vectors in the balls of their present clusters, written to the shared folder."""
    apart = between(centroids)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ball = b.column("ball").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(assign(_rows(b), ball, centroids, apart)[0], pa.int32())], ["vec_id", "v", "ball"])

    return materialise(table.mapInArrow(part, "vec_id long, v array<int>, ball int"), "balls")


def round_sums(balls: DataFrame, centroids: np.ndarray) -> tuple[dict[int, tuple[int, list[int]]], int, int]:
    """Of one round: count and component sums of each cluster that has members, the vectors outside their balls, and all vectors."""
    apart, dims = between(centroids), centroids.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, moved = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)
        for b in batches:
            if b.num_rows:
                x, ball = _rows(b), b.column("ball").to_numpy(zero_copy_only=False).astype(np.int64)
                cluster, _ = assign(x, ball, centroids, apart)
                for c in np.unique(cluster).tolist():
                    own = cluster == c
                    counts[c] += own.sum()
                    sums[c] += x[own].sum(0)
                    moved[c] += (ball[own] != c).sum()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(moved[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "moved", "sums"])

    parts = balls.select("v", "ball").mapInArrow(part, "cluster int, n long, moved long, sums array<long>")
    # the count and the vectors outside come along as components -2 and -1, so one shuffle adds up all
    longer = F.concat(F.array("n", "moved"), "sums")
    totals = parts.select("cluster", F.posexplode(longer).alias("pos", "value")).groupBy("cluster", "pos").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect()  # k x (dims + 2) numbers
    found: dict[int, dict[int, int]] = {}
    for r in totals:
        found.setdefault(r["cluster"], {})[r["pos"]] = int(r["value"])
    out = {c: (v[0], [v[2 + i] for i in range(dims)]) for c, v in found.items()}
    return out, sum(v[1] for v in found.values()), sum(v[0] for v in found.values())


def ball_kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of each kept vector after so many rounds, and the centroids (at most k x dims integers).

    ``distance`` is squared. A new centroid is the exact floor of the mean of its members; one without members stays. Fewer vectors
    than k give fewer clusters, none gives an empty table. The table behind the result stays in the shared folder.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kept = integer_vectors(vectors, dims, scale, key, column)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    balls = _in_balls(kept.withColumn("ball", F.lit(0)), centroids)
    for _ in range(rounds):
        sums, moved, n = round_sums(balls, centroids)
        if moved > MOVED * n:
            balls, old = _in_balls(balls, centroids), balls
            release(old)
        centroids = centroids.copy()
        for c, (members, total) in sums.items():
            centroids[c] = [s // members for s in total]
    apart = between(centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cluster, distance = assign(_rows(b), b.column("ball").to_numpy(zero_copy_only=False).astype(np.int64), centroids, apart)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = materialise(balls.mapInArrow(last, "vec_id long, cluster int, distance long"), "clusters")
    release(balls)
    return out, centroids


def with_inertia(spark: SparkSession, assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with ``cluster_inertia`` and ``inertia`` (distances summed over a cluster and over all) and ``centroid_sha256``, the
    lowercase hex sha256 of a final centroid's components joined by commas."""
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row for each cluster
    total = sum(r["s"] for r in own)
    about = [(r["cluster"], r["s"], total, ",".join(str(int(x)) for x in centroids[r["cluster"]])) for r in own]
    small = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, components string")
    named = small.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """:func:`ball_kmeans` with the columns of :func:`with_inertia`."""
    assigned, centroids = ball_kmeans(vectors, k, rounds, dims, scale, seed)
    return with_inertia(vectors.sparkSession, assigned, centroids)


def oracle_sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in DuckDB, every vector compared with every centroid."""
    bound = component_bound(dims)
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(greatest(least(floor({scale} * CAST(x AS DOUBLE)), {bound}), -{bound}) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        "long AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(v) AS m, generate_subscripts(v, 1) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept) WHERE c < {k})",
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, c, sum((x - m) * (x - m)) AS d FROM long JOIN c{t} USING (i) GROUP BY r, c) GROUP BY r)")
        if t < rounds:
            steps.append(f"m{t} AS (SELECT best.c AS c, i, sum(x) AS s, count(*) AS n FROM d{t} JOIN long USING (r) GROUP BY ALL)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN m ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS m FROM c{t} LEFT JOIN m{t} USING (c, i))")
    return f"""WITH {", ".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM d{rounds} JOIN kept USING (r) JOIN h ON best.c = h.c"""


ORACLE_SQL = oracle_sql()
