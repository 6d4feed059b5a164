"""Packing and ball k-means against plain versions, and on odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from specaudit.llm import ball_kmeans, packing  # noqa: E402

WORD = P.path("word_bpe_49k.json")
NAMES = ("length", "cluster", "ball", "v", "row_", "shard_", "sequence_id", "offset", "ids", "distance", "h")


def plain_packing(lengths, capacity):
    """Every open sequence is tried with each piece, the longest first; the sum of squares is counted anew."""
    gaps, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        s = lengths[i]
        fits = sorted({g for g in gaps if g >= s and g > 0})

        def cost(g):
            after = list(gaps)
            after[after.index(g)] -= s
            return sum(after.count(x) ** 2 for x in set(after) if x > 0)

        if s < capacity and fits:
            g = min(fits, key=lambda g: (cost(g), g))
            gaps[gaps.index(g)] -= s
        else:
            g = capacity
            gaps.append(capacity - s)
        where[i] = capacity - g
    return gaps, where


def test_pieces_go_where_squares_become_smallest():
    rng = random.Random(5)
    for n, capacity in ((0, 10), (1, 10), (40, 10), (120, 37), (60, 100), (30, 1)):
        lengths = [rng.randint(1, capacity) for _ in range(n)]
        sequence, offset = packing.sum_of_squares(np.array(lengths, np.int64), capacity)
        gaps, where = plain_packing(lengths, capacity)
        fill = {}
        for s, q, o in sorted(zip(lengths, sequence.tolist(), offset.tolist(), strict=True), key=lambda x: x[2]):
            assert fill.get(q, 0) == o  # gapless
            fill[q] = o + s
        assert max(fill.values(), default=0) <= capacity
        assert sorted(capacity - f for f in fill.values()) == sorted(gaps)
        assert {i: int(o) for i, o in enumerate(offset)} == where


def check_packed(docs, rows, capacity, end_id):
    """Pieces hold the library's ids of all documents, and sequences are gapless and within their capacity."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    expected = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            expected.append((i, p, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(expected, key=key)
    at = {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at), sum(x[3] for x in expected)


def test_packed_documents_hold_the_librarys_ids(spark):
    rng = random.Random(1)
    words = "Straße the a, Élan of to Σίσυφος 日本 x1 <|endoftext|> |".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.7))))[:40_000]) for i in range(700)]
    docs += [(-1, None), (-2, ""), (5, docs[5][1]), (5, docs[5][1]), (None, "no id"), (None, None), (9000, "the " * 2047), (9001, "the " * 2048), (9002, "the " * 4095)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for capacity, shard in ((2048, 10_000), (64, 150), (1, 50)):
        rows = packing.place(packing.pieces(frame, WORD, 0, capacity, with_ids=False), capacity, shard).collect()
        used, tokens = check_packed(docs, rows, capacity, 0)
        shards = max(1, -(-sum(r["length"] < capacity for r in rows) // shard))
        assert used <= 1.01 * tokens / capacity + 2 * shards


def test_sequences_give_the_documents_back(spark):
    docs = [(i, " ".join(["the", "of", "and"][: i % 3 + 1] * (i % 17))) for i in range(60)]
    packed = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), WORD, 0, 16, with_ids=True)
    rows, found = {(r["doc_id"], r["piece"]): r["ids"] for r in packed.collect()}, {}
    for s in packing.sequences(packed).collect():
        assert len(s["input_ids"]) == s["n_tokens"] <= 16 and s["starts"] == sorted(s["starts"])
        for doc, a, b in zip(s["doc_ids"], s["starts"], [*s["starts"][1:], s["n_tokens"]], strict=True):
            found.setdefault(doc, []).append(tuple(s["input_ids"][a:b]))
    for i, _ in docs:
        assert sorted(found[i]) == sorted(tuple(v) for (d, _), v in rows.items() if d == i)


def test_packing_takes_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a row"), (1, "a row"), (None, None), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    for name in NAMES:
        docs = docs.withColumn(name, F.lit(7))
    rows = packing.pack_documents(docs, WORD, 0, 2048).collect()
    check_packed([(1, "a row"), (1, "a row"), (None, None), (2, ""), (3, "x" * 100_000)], rows, 2048, 0)
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0
    with pytest.raises(ValueError, match="one token"):
        packing.pieces(docs, WORD, 0, 0)


def plain_kmeans(vectors, k, rounds, scale=1024, dims=64, seed=3):
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * x)) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    sums = {j: sum(d for _, c, d in out if c == j) for j in range(len(centroids))}
    return [(i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out]


def found(spark, vectors, **args):
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    return [tuple(r) for r in ball_kmeans.cluster_vectors(frame, **args).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_ball_kmeans_equals_plain_kmeans(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 64))
    vectors = [(i, (centres[i % 5] + 0.3 * rng.normal(size=64)).tolist()) for i in range(300)]
    vectors += [(7, vectors[7][1])] * 40 + [(None, vectors[3][1])]
    assert order(found(spark, vectors)) == order(plain_kmeans(vectors, 8, 10))
    # ties everywhere: few points on a grid, and rounds in which many vectors leave their balls
    grid = [(i, rng.integers(-1, 2, 3).tolist()) for i in range(200)]
    grid = [(i, [float(x) for x in v]) for i, v in grid]
    for k, rounds in ((8, 10), (3, 0), (1, 2), (20, 4)):
        assert order(found(spark, grid, k=k, rounds=rounds, dims=3, scale=1)) == order(plain_kmeans(grid, k, rounds, 1, 3))


def test_any_balls_give_the_nearest_centroids():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, c = rng.integers(-4, 5, (200, 3)), rng.integers(-4, 5, (7, 3))
        d = ((x[:, None] - c) ** 2).sum(2)
        cluster, best = ball_kmeans.assign(x, rng.integers(0, 7, 200), c, ball_kmeans.between(c))
        assert (cluster == d.argmin(1)).all() and (best == d.min(1)).all()


def test_ball_kmeans_takes_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25]
    rows = [(1, good), (1, good), (None, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [-0.0, 1e-320])]
    assert order(found(spark, rows, dims=2)) == order(plain_kmeans(rows, 8, 10, dims=2))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in NAMES:
        frame = frame.withColumn(name, F.lit(7))
    assert ball_kmeans.cluster_vectors(frame, dims=2).count() == 4
    assert ball_kmeans.cluster_vectors(frame.limit(0)).count() == 0
    # components beyond the bound are taken as it, so every distance fits in 64 bits
    far = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])]
    bound = ball_kmeans.component_bound(2)
    got = {r[0]: r for r in found(spark, far, dims=2, k=1, rounds=0)}
    assert max(r[2] for r in got.values()) in (bound**2, (2 * bound) ** 2)
    assert ball_kmeans.component_bound(64) == 1 << 26


def test_only_relevant_centroids_are_compared(monkeypatch):
    """Two far groups of two near balls: members are compared with the ball beside theirs alone, cores with none."""
    c = np.array([[0, 0], [10, 0], [1000, 0], [1010, 0]])
    x = np.array([[1, 0], [4, 0], [6, 0], [1001, 0]])
    asked = []
    real = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, side="left": asked.append((len(a), real(a, v, side=side).tolist())) or real(a, v, side=side))
    cluster, _ = ball_kmeans.assign(x, np.array([0, 0, 0, 2]), c, ball_kmeans.between(c))
    assert cluster.tolist() == [0, 0, 1, 2]
    assert asked == [(1, [0, 0, 1]), (0, [0])]  # a neighbour of ball 0, for the one member beyond its core; none of ball 2
