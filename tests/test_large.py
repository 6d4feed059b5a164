"""Steps that cut large tables into ranges and blocks, on small tables with small ranges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from specaudit.functions import ranking
from specaudit.operators import axis as axis_module
from specaudit.operators import groups, inference, nulls, outcome, splits
from specaudit.plans import audit


@pytest.fixture
def ranges(monkeypatch):
    monkeypatch.setattr(ranking, "SMALL", 40)


def adjusted(p: np.ndarray) -> np.ndarray:
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


def test_q_by_ranges_equals_one_order(spark, ranges):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(700) ** 4, 3)  # ties across and within families
    families = [None if i % 5 == 0 else f"f{i % 3}" for i in range(700)]
    rows = [(i, f, float(v)) for i, (f, v) in enumerate(zip(families, p, strict=True))] + [(900, "f1", None), (901, "bare", None)]
    df = spark.createDataFrame(rows, "set_name int, family string, p double")
    got = {r["set_name"]: r for r in nulls.bh_fdr(df, family="family").collect()}
    assert len(got) == 702 and got[900]["q"] is None and not got[900]["rejected"]
    for f in set(families):
        at = [i for i, x in enumerate(families) if x == f]
        want = adjusted(p[at])
        assert np.allclose([got[i]["q"] for i in at], want, rtol=0, atol=1e-12)
        assert [got[i]["rejected"] for i in at] == (want <= 0.05).tolist()
    alone = nulls.bh_fdr(df.filter("p IS NOT NULL"))
    assert np.allclose([r["q"] for r in alone.orderBy("set_name").collect()], adjusted(p), rtol=0, atol=1e-12)
    audit = {r["family"]: (r["n"], r["n_tied"], r["max_q_delta"]) for r in nulls.bh_tie_audit(df, family="family").collect()}
    counts = {f: np.unique(p[[i for i, x in enumerate(families) if x == f]], return_counts=True)[1] for f in set(families)}
    assert audit == {f: (c.sum(), c[c > 1].sum(), 0.0) for f, c in counts.items()} | {"bare": (0, 0, None)}


def test_no_window_of_q_looks_ahead(spark):
    """A running least that ends at the last row is found anew for each row, which is quadratic."""
    df = spark.range(100).select(F.col("id").alias("set_name"), (F.col("id") / 100).alias("p"))
    for q in (nulls.bh_fdr(df), nulls.bh_tie_audit(df)):
        assert "currentrow$(), unboundedfollowing" not in q._jdf.queryExecution().optimizedPlan().toString().lower()


def test_places_of_many_groups_whatever_their_columns_are_called(spark, ranges):
    df = spark.range(400).select(F.col("id").alias("key"), F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("_n"), F.lit("x").alias("_range"), F.lit(1).alias("_before"))
    got = ranking.rank_in_order(df, "key", name="_p", by=["_n"])
    assert got.columns == [*df.columns, "_p"]
    want: dict = {}
    for r in sorted(got.collect()):
        assert r["_p"] == want.get(r["_n"], 0)
        want[r["_n"]] = r["_p"] + 1
    assert sum(want.values()) == 400 and None in want


def test_group_kfold_over_ranges(spark, ranges):
    df = spark.range(500).select((F.col("id") % 199).alias("g"))
    sizes = {g: len(range(g, 500, 199)) for g in range(199)}
    load, want = [0] * 5, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], -g)):
        want[g] = load.index(min(load))
        load[want[g]] += sizes[g]
    assert {r["g"]: r["fold"] for r in splits.group_kfold(df, "g").collect()} == want


def broadcasts(df) -> list[str]:
    """The rows under each broadcast of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    out = []
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            under = next((k for k in range(i + 1, len(plan)) if depth(plan[k]) <= depth(line)), len(plan))
            out.append("\n".join(plan[i:under]))
    return out


def test_random_sets_over_ranges(spark, ranges):
    bins = spark.range(300).select(F.col("id").cast("int").alias("gene"), (F.col("id") % 3).cast("int").alias("bin"))
    sets = bins.select(F.when(F.col("gene") < 200, "a").otherwise("b").alias("set_name"), "gene")
    for matched in (True, False):
        df = nulls.random_sets(sets, bins, n_draws=4, matched=matched)
        assert not any("Generate" in b for b in broadcasts(df))  # listed places are never broadcast
        rows = df.collect()
        assert len({(r["set_name"], r["draw"], r["gene"]) for r in rows}) == len(rows) == 4 * 300


def test_resampled_clusters_carry_their_sums(spark, ranges):
    clusters = spark.range(90).select((F.col("id") * 2).alias("cluster"), F.lit(3).alias("n"), F.col("id").cast("double").alias("v"))
    df = inference.resample(clusters, 5)
    assert not any("Generate" in b for b in broadcasts(df))
    rows = df.collect()
    assert all(r["v"] * 2 == r["cluster"] and r["n"] == 3 for r in rows)
    assert {b: sum(r["w"] for r in rows if r["replicate"] == b) for b in range(5)} == dict.fromkeys(range(5), 90)


def test_average_ranks_by_ranges(spark, ranges):
    rng = np.random.default_rng(1)
    v, w, g = rng.integers(0, 60, 500), rng.integers(1, 4, 500), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(i, None if g[i] else "x", int(v[i]), int(w[i])) for i in range(500)], "k int, g string, v int, w int")
    got = ranking.with_average_rank(df, "v", "r", ["g"], "w")
    assert "_rank_before" in got._jdf.queryExecution().logical().toString()  # it was cut
    for r in got.collect():
        mine = (g == 1) == (r["g"] is None)
        below, same = w[mine & (v < r["v"])].sum(), w[mine & (v == r["v"])].sum()
        assert r["r"] == below + (same + 1) / 2


def survival_rows(spark, n: int, scores: int):
    rng = np.random.default_rng(5)
    time, event, score = rng.integers(1, 30, n).astype(float), (rng.random(n) < 0.4).astype(float), rng.integers(0, scores, n).astype(float)
    return spark.createDataFrame([(i, "a" if i % 3 else "b", float(t), float(e), float(s)) for i, (t, e, s) in enumerate(zip(time, event, score, strict=True))], "sample int, set_name string, time double, event double, score double")


def test_hazards_and_concordance_of_large_keys(spark, ranges, monkeypatch):
    df = survival_rows(spark, 600, 50)
    small = {r["set_name"]: r for r in outcome.cox_by(df, ["set_name"]).collect()}
    c = {r["set_name"]: r for r in outcome.concordance(df, ["set_name"]).collect()}
    monkeypatch.setattr(outcome, "SPLIT_ROWS", 300)  # one key above, one below
    for r in outcome.cox_by(df, ["set_name"]).collect():
        assert np.allclose([r["coef"], r["se"]], [small[r["set_name"]]["coef"], small[r["set_name"]]["se"]], rtol=1e-9) and r[3:] == small[r["set_name"]][3:]
    for r in outcome.concordance(df, ["set_name"]).collect():
        assert np.isclose(r["c_index"], c[r["set_name"]]["c_index"], rtol=1e-12) and r[2:] == c[r["set_name"]][2:]


def test_a_score_with_very_many_rows_is_a_few_cells(spark, ranges, monkeypatch):
    count = outcome.count_concordant
    df = survival_rows(spark, 900, 2).drop("set_name")
    want = outcome.concordance(df).first()
    monkeypatch.setattr(outcome, "SPLIT_ROWS", 300)
    got = outcome.concordance(df)
    assert np.isclose(got.first()["c_index"], want["c_index"], rtol=1e-12) and got.first()["n"] == 900
    t, e, s, n = np.array([1.0, 2, 2]), np.array([1.0, 0, 1]), np.array([5.0, 5, 1]), np.array([2, 3, 4])
    assert count(t, e, s, n) == count(np.repeat(t, n), np.repeat(e, n), np.repeat(s, n))


def test_scores_of_draws_are_not_broadcast(spark):
    df = survival_rows(spark, 300, 50)
    null = df.select("sample", F.lit("a").alias("set_name"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("draw"), "score")
    for metric in ("c_index", "coef"):
        arm = outcome.outcome_arm(df.select("sample", F.lit("a").alias("set_name"), "score"), null, df.select("sample", "time", "event"), df.select("sample", F.col("time").alias("axis")), metric=metric)
        assert not any("Generate" in b for b in broadcasts(arm))


@pytest.mark.parametrize("block", [7, 1000])
def test_cells_of_permutations_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(groups, "BLOCK_ROWS", block)
    df = spark.range(60).select(F.col("id").alias("k"), F.concat(F.lit("s"), F.col("id") % 4).alias("site"), (F.col("id") % 3 == 0).cast("string").alias("type"), (F.col("id") % 5).alias("x"), (F.col("id") / 7).alias("v"))
    for within in (None, "type"):
        want = groups.permuted(df, "k", "site", 30, 2, within, ["x", "v"]).groupBy("perm", "site", "x").agg(F.count("*").alias("n"), F.round(F.sum("v"), 9).alias("s"))
        got = groups.permuted_cells(df, "k", "site", 30, 2, within, "x", "v").withColumn("s", F.round("s", 9))
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()  # no row of a permutation is shuffled


def test_group_baseline_holds_cells_not_rows(spark):
    rows = [(i, "a" if i % 2 else "b", None if i % 7 == 0 else i % 3, i % 5, None if i % 11 == 0 else float(i * i % 17)) for i in range(200)] + [(200, "a", 99, 1, 4.0)]
    df = spark.createDataFrame(rows, "k int, set_name string, g int, fold int, y double")
    got = audit.group_baseline(df, "y", "g", keys=["set_name"])
    plan = [line.strip(" :+-") for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    for i, line in enumerate(plan):
        if line.startswith("Window"):
            assert next(x for x in plan[i + 1 :] if not x.startswith(("Window", "Project"))).startswith("Aggregate")
    for r in got.collect():
        train = [x for x in rows if x[1] == r["set_name"] and x[3] != r["fold"] and x[4] is not None]
        own = [x[4] for x in train if x[2] == r["g"]] or [x[4] for x in train]
        assert np.isclose(r["baseline"], np.mean(own))


def test_pairs_by_halves_of_time_equal_a_count_of_all():
    rng = np.random.default_rng(2)
    for trial in range(60):
        n = int(rng.integers(0, 30))
        t, s = rng.integers(1, 12, n).astype(float), rng.integers(0, 1 + trial % 9, n).astype(float)
        s[rng.random(n) < 0.1] = np.nan  # the largest, and all equal
        k = rng.integers(1, 4, n) if trial % 2 else np.ones(n, int)
        e = rng.integers(0, 9, n) % (k + 1)
        v = np.nan_to_num(s, nan=np.inf)
        w = np.where(t[None, :] > t[:, None], e[:, None] * k[None, :], 0)
        assert outcome.pair_counts(t, s, k, e) == (w[v[None, :] < v[:, None]].sum(), w[v[None, :] == v[:, None]].sum(), w.sum())


@pytest.mark.parametrize("split", [40, 1000])
def test_scores_of_draws_meet_their_samples_once(spark, monkeypatch, split):
    """Both adjustments and all passes take them from what is held; a sample with two rows of survival counts once in its line."""
    monkeypatch.setattr(outcome, "SPLIT_ROWS", split)
    df = survival_rows(spark, 200, 30)
    met = spark.sparkContext.accumulator(0)

    def seen(x):
        met.add(1)
        return x

    score = F.udf(seen, "double")((F.col("sample") * (F.col("draw") + 7) % 53).cast("double")).alias("score")
    plain = df.select("sample", F.lit("a").alias("set_name"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("draw"))
    null, own = plain.select("sample", "set_name", "draw", score), df.select("sample", F.lit("a").alias("set_name"), "score")
    survival = df.select("sample", "time", "event", F.col("set_name").alias("type")).filter("sample % 10 <> 3")
    survival = survival.unionByName(survival.filter("sample % 10 = 4").withColumn("time", F.col("time") + 3))
    axis = df.select("sample", F.when(F.col("sample") % 9 != 0, F.col("sample") % 17).cast("double").alias("axis"), F.when(F.col("sample") % 5 != 0, "x").alias("type"))
    got = {r["adjustment"]: r for r in outcome.outcome_arm(own, null, survival, axis, "type", "type").collect()}
    assert met.value == 1200
    again = spark.createDataFrame(null.collect(), null.schema)
    for kind in ("raw", "axis_residualised"):
        off = lambda x: axis_module.residualise(x, axis, "type").select("sample", F.col("residual").alias("score"))
        c = []
        for x in (own, *(again.filter(F.col("draw") == d).drop("draw") for d in range(6))):
            rows = (x.select("sample", "score") if kind == "raw" else off(x)).join(survival, "sample")
            p = outcome.concordance_pairs(rows, ["type"], 0).agg(F.sum(F.col("c_index") * F.col("n_pairs")) / F.sum("n_pairs"), F.sum("n_pairs")).first()
            c.append(p[0])
        assert np.isclose(got[kind]["observed"], c[0], rtol=1e-12) and got[kind]["n_null"] == 6
        z = np.arctanh(2 * (0.5 + np.abs(np.array(c) - 0.5)) - 1)
        assert np.isclose(got[kind]["excess_z"], z[0] - z[1:].mean(), rtol=1e-9, atol=1e-12)
