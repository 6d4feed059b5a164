"""Comparisons of runs, folds, ranks, outcomes, claims, hashes and shards against plain Python."""

import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specaudit.functions import ranking, special, stats
from specaudit.operators import axis, batch, compare, inference, nulls, outcome, ridge, scoring, splits, variance
from specaudit.plans import audit, build, sweep
from specaudit.sources import manifest, tables
from specaudit.streaming import moments


def test_ranks_by_ranges_equal_one_order(spark, monkeypatch):
    rng = random.Random(0)
    rows = [(i, rng.choice([None, *range(40)]), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v int, g string")
    for by in ([], ["g"]):
        monkeypatch.setattr(ranking, "SMALL", 10**6)
        want = {r["k"]: r["place"] for r in ranking.rank_in_order(df, "v", "k", by=by).collect()}
        monkeypatch.setattr(ranking, "SMALL", 10)
        assert {r["k"]: r["place"] for r in ranking.rank_in_order(df, "v", "k", by=by).collect()} == want
    assert sorted(want.values()) != list(range(500)) and ranking.rank_in_order(df.limit(0), "v", "k").count() == 0


def test_folds_by_size_equal_the_greedy(spark):
    rng = random.Random(1)
    for n_folds in (2, 3, 5):
        for _ in range(40):
            sizes = [rng.choice([1, 1, 2, 3, 5, 8, 13, 40]) for _ in range(rng.randint(n_folds, 60))]
            order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], -k))
            load, want = [0] * n_folds, {}
            for k in order:
                want[k] = load.index(min(load))
                load[want[k]] += sizes[k]
            counts = [(s, sizes.count(s)) for s in set(sizes)]
            turns = splits.deal_by_size(counts, n_folds)
            for s, c in counts:
                own = [k for k in order if sizes[k] == s]
                first, cycle = turns[s]
                assert [want[k] for k in own] == [(first + cycle * c)[i] for i in range(c)] if len(first) >= c else [first[i] if i < len(first) else cycle[(i - len(first)) % n_folds] for i in range(c)] == [want[k] for k in own]
    rows = spark.createDataFrame([(k,) for k, s in enumerate(sizes) for _ in range(s)], "g long")
    assert {r["g"]: r["fold"] for r in splits.group_kfold(rows, "g", 5).collect()} == want


def test_exact_folds_are_the_most_even(spark):
    rng = random.Random(2)
    for _ in range(15):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(3, 8))]
        table = pd.DataFrame({"site": [f"s{i}" for i in range(len(sizes))], "n": sizes})
        got = splits.assign_sites_exactly(table, 3)
        cost = lambda folds: sum((sum(s for s, f in zip(sizes, folds, strict=True) if f == k) - sum(sizes) / 3) ** 2 for k in range(3))  # noqa: B023, E731
        best = min(cost(f) for f in itertools.product(range(3), repeat=len(sizes)))
        assert cost([got[f"s{i}"] for i in range(len(sizes))]) == pytest.approx(best)
    for n in (17, 20, 700):  # proved by folds that are as even as whole numbers can be: planted, or almost sure with so many sites
        cuts = [sorted(rng.sample(range(1, 400), n // 5 - (k >= n % 5))) for k in range(5)]
        sizes = [b - a for c in cuts for a, b in zip([0, *c], [*c, 400], strict=True)] if n < 100 else [int(rng.paretovariate(0.8)) % 500 + 1 for _ in range(n)]
        n = len(sizes)
        got = splits.assign_sites_exactly(pd.DataFrame({"site": range(n), "n": sizes}), 5)
        assert sum(sum(s for i, s in enumerate(sizes) if got[i] == k) ** 2 for k in range(5)) == splits.even_squares(sum(sizes), 5)
    # nothing proves an uneven assignment of many sites of three sizes within a few steps
    with pytest.raises(ValueError, match="no proof.*gap"):
        splits.assign_sites_exactly(pd.DataFrame({"site": range(32), "n": [7, 11, 13, 1000] * 8}), 5, max_steps=50)
    rows = spark.createDataFrame([(f"P{i}", f"S{i % 20}") for i in range(200)], "patient_id string, site string")
    s = splits.preserved_site_split(rows, "site", exact=True)
    assert not s.notes and s.folds.count() == 200
    few = splits.preserved_site_split(rows.filter("site < 'S2'"), "site", n_folds=2, exact=True)
    sizes = few.folds.groupBy("fold").count().collect()
    assert not few.notes and max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 10
    b = splits.fold_balance(rows.withColumn("outcome", F.lit(1.0)).join(s.folds, F.col("patient_id") == F.col("key")))
    assert splits.fold_balance_report(b).startswith("fold sizes 40 to 40")


def test_site_folds_level_outcomes(spark):
    rng = np.random.default_rng(0)
    table = pd.DataFrame({"site": range(40), "n": rng.integers(5, 60, 40), "outcome": rng.normal(size=40)})
    got = splits.assign_sites(table, 5)
    table["fold"] = table["site"].map(got)
    n = table.groupby("fold")["n"].sum()
    plain = pd.DataFrame({"site": table["site"], "n": table["n"]})
    assert n.max() < 1.3 * n.min() and got == splits.assign_sites(table, 5)
    assert splits.assign_sites(plain, 5, seed=0, jitter=0.25) != splits.assign_sites(plain, 5, seed=1, jitter=0.25)
    mean = lambda folds: (table["outcome"] * table["n"]).groupby(table["site"].map(folds)).sum() / table["n"].groupby(table["site"].map(folds)).sum()
    assert mean(got).std() < mean(splits.assign_sites(plain, 5)).std() + 0.05


def test_mann_whitney_p_equals_all_relabellings(spark):
    rng = random.Random(3)
    for _ in range(10):
        n1, n2 = rng.randint(1, 4), rng.randint(1, 5)
        values = rng.sample(range(100), n1 + n2)
        u_of = lambda chosen: sum(values[i] > values[j] for i in chosen for j in range(len(values)) if j not in chosen)  # noqa: B023, E731
        u, every = u_of(range(n1)), [u_of(c) for c in itertools.combinations(range(n1 + n2), n1)]
        less, more = np.mean([x <= u for x in every]), np.mean([x >= u for x in every])
        assert special.mann_whitney_p(u, n1, n2, alternative="less") == pytest.approx(less)
        assert special.mann_whitney_p(u, n1, n2) == pytest.approx(min(1, 2 * min(less, more)))
    # normal approximation with ties, by hand: 12 and 12 values in two tied blocks
    df = spark.createDataFrame([("g", float(i % 3), i < 12) for i in range(24)] + [("h", float(i), i < 2) for i in range(5)], "k string, v double, f boolean")
    r = {x["k"]: x for x in compare.mann_whitney(df, "v", F.col("f"), "k").collect()}
    assert r["g"]["u"] == 72 and r["g"]["z"] == 0 and r["g"]["ties"] == 3 * (8**3 - 8) and r["g"]["p_two_sided"] == pytest.approx(1.0, abs=0.03)
    assert r["h"]["u"] == 0 and r["h"]["p_less"] == pytest.approx(0.1) and r["h"]["p_two_sided"] == pytest.approx(0.2)
    assert math.isnan(special.mann_whitney_p(0, 0, 3))


def test_concordance_of_large_strata_equals_the_kernel(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("a" if i % 3 else "b", float(rng.integers(1, 60)), float(rng.integers(0, 2)), float(rng.integers(0, 25))) for i in range(600)]
    df = spark.createDataFrame(rows, "s string, time double, event double, score double")
    want = [tuple(r) for q in (outcome.concordance(df), outcome.concordance(df, strata="s"), outcome.concordance(df, keys=["s"]).orderBy("s")) for r in q.collect()]
    pairs = {r["s"]: r["c_index"] for r in outcome.concordance_pairs(df, ["s"]).collect()}
    monkeypatch.setattr(outcome, "SPLIT_ROWS", 250)
    got = [tuple(r) for q in (outcome.concordance(df), outcome.concordance(df, strata="s"), outcome.concordance(df, keys=["s"]).orderBy("s")) for r in q.collect()]
    for a, b in zip(got, want, strict=True):
        assert a[:-3] == b[:-3] and a[-3] == pytest.approx(b[-3]) and a[-2:] == b[-2:]
    assert pairs == {r[0]: pytest.approx(r[1]) for r in got[2:]}


def test_hazards_in_groups_and_on_types(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    t = rng.exponential(np.exp(-0.5 * x)).round(2) + 0.01
    e = (rng.random(300) < 0.7).astype(float)
    kind = ["abc"[i % 3] for i in range(300)]
    df = spark.createDataFrame([(float(a), float(b), float(c), k) for a, b, c, k in zip(t, e, x, kind, strict=True)], "time double, event double, score double, type string")
    whole = outcome.cox(df)
    one = outcome.cox_by(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert one["coef"] == pytest.approx(whole["coef"], abs=1e-7) and one["se"] == pytest.approx(whole["se"], abs=1e-7) and one["n_events"] == whole["n_events"] == int(e.sum())
    few = outcome.cox(df.filter("event = 0 OR time > 4").limit(60))
    assert math.isnan(few["coef"]) and few["n_events"] == df.filter("event = 0 OR time > 4").limit(60).filter("event = 1").count()
    z = np.column_stack([[k == v for k in kind] for v in "bc"]).astype(float)
    beta, _ = outcome.newton(t, e, z)
    lp = z @ beta
    won, pairs = outcome.count_concordant(t, e, lp)
    assert outcome.type_hazard_concordance(df, "type").first()["c_index"] == pytest.approx(won / pairs)
    p = outcome.type_rates(df, "type").filter("type = 'a'").first()["proportion"]
    assert p == pytest.approx(e[::3].mean())
    null = df.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("draw"), "time", "event", F.rand(1).alias("score"))
    seen = outcome.cox_by(df.withColumn("set_name", F.lit("s")), ["set_name"])
    got = outcome.outcome_null(seen, outcome.cox_by(null.withColumn("set_name", F.lit("s")), ["set_name", "draw"]), metric="coef").first()
    assert got["metric"] == "coef" and got["beats_null"] and got["n_null"] == 8
    with pytest.raises(ValueError):
        outcome.outcome_null(seen, seen, metric="other")
    assert outcome.endpoint_warning("PFI") is None and "over 3 cancer types" in outcome.endpoint_warning("OS", df)


def test_axis_equals_svd_with_more_samples_than_genes_and_the_reverse(spark):
    rng = np.random.default_rng(6)
    for n, g in ((60, 12), (12, 60)):
        e = rng.normal(size=(n, 1)) @ rng.uniform(0.5, 1, (1, g)) + 0.4 * rng.normal(size=(n, g))
        df = spark.createDataFrame([(i, j, float(e[i, j])) for i in range(n) for j in range(g)], "sample long, gene int, value double")
        z = (e - e.mean(0)) / e.std(0, ddof=1)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        want = u[:, 0] * s[0] * np.sign(u[:, 0] @ z.mean(1))
        got = {r["sample"]: r["axis"] for r in axis.global_axis_pc1(df).collect()}
        assert np.allclose([got[i] for i in range(n)], want)


def test_pooled_bootstrap_has_the_sets_as_n_and_all_draws_as_its_value(spark):
    rng = np.random.default_rng(7)
    n = 120
    rows = []
    for i in range(n):
        sets = []
        for _ in range(2):
            v = []
            for d in range(7):
                t = rng.normal()
                v += [float(t), float((0.9 if d == 0 else 0.2) * t + rng.normal())]
            sets.append(v)
        rows.append((i, sets))
    rows.append((n, [[1.0], [1.0]]))
    rows[5][1][0][3] = None
    df = spark.createDataFrame(rows[:-1], "key long, sets array<array<double>>")
    r = inference.pooled_bootstrap(df, {"a": (None, []), "b": (None, [])}, n_boot=60)
    assert r["n"] == 2 and r["n_rows"] == n - 1 and r["n_dropped"] == 1 and r["lo"] < r["value"] < r["hi"] and r["n_draws"] == 60
    x = np.array([s for k, (_, s) in enumerate(rows[:-1]) if k != 5], float)
    z = lambda a, b: np.arctanh(np.corrcoef(a, b)[0, 1])
    own = np.mean([z(x[:, k, 0], x[:, k, 1]) - np.mean([z(x[:, k, 2 * d], x[:, k, 2 * d + 1]) for d in range(1, 7)]) for k in range(2)])
    assert r["value"] == pytest.approx(own)
    assert inference.pooled_bootstrap(df, {"a": (None, []), "b": (None, [])}, n_boot=30, point={"a": 0.5, "b": 0.7, "c": None})["value"] == pytest.approx(0.6)
    w = inference.poisson_weights(np.arange(4000), 50, 3)
    assert (w[0] == 1).all() and abs(w[1:].mean() - 1) < 0.02 and abs(w[1:].var() - 1) < 0.05
    assert np.array_equal(w[:, 7:9], inference.poisson_weights(np.arange(7, 9), 50, 3))
    t = inference.summarise({"x": r})
    assert t["name"].tolist() == ["x"] and t["value"][0] == r["value"]
    assert inference.effective_tests(np.array([[1.0, 0.4], [0.2, 1.0]])) == pytest.approx(inference.effective_tests(np.array([[1.0, 0.3], [0.3, 1.0]])))


def test_combat_outside_folds_equals_refits(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "xyz"[i % 3] if i < 58 else "rare", int(rng.integers(0, 4)), d, float(rng.normal() + 1e6 + (i % 3))) for i in range(60) for d in range(2)]
    fold = {i: f for i, _, f, _, _ in rows}
    long = spark.createDataFrame([(i, b, fold[i], d, v) for i, b, _, d, v in rows], "key long, batch string, fold int, dim int, value double")
    got = {(r["key"], r["dim"]): (r["corrected"], r["estimable"]) for r in batch.combat_out_of_fold(long, 4).collect()}
    for k in range(4):
        part = batch.apply_combat(long.filter(F.col("fold") == k), batch.fit_combat(long.filter(F.col("fold") != k)))
        for r in part.collect():
            assert got[r["key"], r["dim"]] == (pytest.approx(r["corrected"], abs=1e-6), r["estimable"])


def test_moments_of_large_means_keep_their_digits(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "k", 1e9 + i % 2) for i in range(50)], "ts string, key string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert moments.windowed_moments(rows, "ts", "value", ["key"]).first()["sd"] == pytest.approx(np.std([i % 2 for i in range(50)], ddof=1))


def test_claims_and_written_digits(spark):
    df = spark.createDataFrame([("0.386",), ("1.669e-41",), ("3e2",), ("1,234.5",), ("17",)], "s string")
    got = [r[0] for r in df.select(compare.written_tolerance(F.col("s"), 5e-5)).collect()]
    assert got == [pytest.approx(x) for x in (5e-4 + 1e-12, 5e-45, 50.0, 0.05 + 1e-12, 0.5)]
    texts = spark.createDataFrame([("a", "r = 0.386 and r = 0.39"), ("b", "nothing")], "source string, text string")
    patterns = spark.createDataFrame([("r", r"r = ([0-9.]+)"), ("q", "q = ([0-9]+)")], "name string, pattern string")
    r = sorted(map(tuple, compare.check_claims(texts, patterns, spark.createDataFrame([("r", 0.3857)], "name string, value double")).select("source", "name", "literal", "status").collect()), key=str)
    assert r == [("a", "q", None, "ABSENT"), ("a", "r", "0.386", "OK"), ("a", "r", "0.39", "OK"), ("b", "q", None, "ABSENT"), ("b", "r", None, "ABSENT")]


def test_stage_hashes_follow_content_alone(spark):
    a = spark.range(3000).select("id", (F.col("id") * 2).alias("v"))
    h = lambda d: manifest.stage_hash(d).first()["sha256"]
    assert h(a) == h(a.orderBy(F.desc("id")).repartition(7)) != h(a.withColumn("v", F.when(F.col("id") == 2999, 0).otherwise(F.col("v"))))
    assert [r["stage"] for r in manifest.staged_hashes({"x": a, "y": a.limit(5)}).orderBy("place").collect()] == ["x", "y"]
    d = {r["stage"]: r for r in compare.stage_differences({"x": (a, a), "y": (a, a.withColumn("v", F.col("v") + 1))}, ["id"], "v").collect()}
    assert not d["x"]["diverges"] and d["y"]["first"] and d["y"]["max_abs"] == 1
    keys = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "k string")
    f = lambda d: tuple(tables.fingerprint(d, "k").first())
    assert f(keys) == f(keys.distinct().orderBy(F.desc("k"))) != f(keys.filter("k = 'a'")) and f(keys)[1] == 2
    k = tables.recorded_fingerprint(keys, "k").first()
    import hashlib

    assert (k["fingerprint"], k["n"]) == (hashlib.sha256(b"a\nb").hexdigest(), 2)


def test_plans_of_arms():
    p = compare.plan_arms(["ssgsea__uncorrected", "mean_z__uncorrected"])
    assert p["selected"] == ["mean_z__uncorrected", "ssgsea__uncorrected"] and p["agreement_possible"] and not p["complete"]
    with pytest.raises(ValueError):
        compare.plan_arms(["plage__uncorrected"])


def test_ties_do_not_move_q(spark):
    rng = np.random.default_rng(0)
    p = [("two", float(v)) for v in np.repeat(rng.uniform(0, 1, 16), 2)] + [("same", 0.04)] * 32
    df = spark.createDataFrame([(i, f, v) for i, (f, v) in enumerate(p)], "set_name int, family string, p double")
    r = {x["family"]: x for x in nulls.bh_tie_audit(df, family="family").collect()}
    assert r["two"]["n_tied"] == r["same"]["n_tied"] == 32 and r["two"]["max_q_delta"] == r["same"]["max_q_delta"] == 0


def test_shards_go_on_where_they_stopped(spark, tmp_path):
    calls = []

    def run(seed):
        calls.append(seed)
        if seed == 2:
            raise ValueError("degenerate")
        return {"value": seed / 10, "lo": 0.0, "hi": 1.0, "n": 4}

    folder = str(tmp_path / "sweep")
    assert sweep.run_shard(spark, [1, 2], run, folder, "a") == (1, 1)
    assert sweep.run_shard(spark, [1, 2, 3], run, folder, "b") == (1, 0) and calls == [1, 2, 3]
    merged, missing = sweep.merge_shards(spark.read.parquet(f"{folder}/per_partition"), ["isi"], spark.range(1, 5).withColumnRenamed("id", "split_seed"))
    assert sorted(r["split_seed"] for r in merged.collect()) == [1, 3] and sorted(r[0] for r in missing.collect()) == [2, 4]
    parts = {r["split_seed"]: r["shard"] for r in sweep.shard_of(spark.range(10).withColumnRenamed("id", "split_seed"), 3).collect()}
    assert [parts[i] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    ratio, lo, hi = special.sd_ratio_interval(2.0, 20, 1.0, 24)
    assert ratio == 2 and lo < 2 < hi and special.sd_ratio_interval(1.0, 20, 1.0, 20)[1] == pytest.approx(1 / special.sd_ratio_interval(1.0, 20, 1.0, 20)[2])


def test_probe_of_the_estimator(spark):
    """One observed and eight random targets of one linear predictor, on folds of equal sites, against NumPy."""
    rng = np.random.default_rng(0)
    n, p = 200, 40
    x = rng.standard_normal((n, p))
    beta = rng.standard_normal(p)
    y = np.column_stack([x @ beta + 2.0 * rng.standard_normal(n), rng.standard_normal((n, 8)) + 0.15 * (x @ beta)[:, None]])
    frame = spark.createDataFrame([(f"P{i:04d}", f"S{i % 20:02d}", [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(n)], "key string, site string, x array<double>, y array<double>")
    folds = splits.preserved_site_split(frame, "site", "key", 5).folds
    rows = frame.join(folds, "key").select("key", "fold", "x", "y")
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [40] * 5
    penalties = ridge.choose_penalties(rows, 5)
    pred = ridge.cross_val_predict(rows, [str(k) for k in range(9)], 5, penalties)
    r = {int(q["target"]): q["r"] for q in pred.groupBy("target").agg(stats.pearson(F.col("y_true"), F.col("y_pred")).alias("r")).collect()}
    fold = np.zeros(n, int)
    for q in folds.collect():
        fold[int(q["key"][1:])] = q["fold"]
    out = np.zeros_like(y)
    for k in range(5):
        m, s = x[fold != k].mean(0), x[fold != k].std(0)
        a, b = (x[fold != k] - m) / s, (x[fold == k] - m) / s
        w = np.linalg.solve(a.T @ a + penalties[k] * np.eye(p), a.T @ (y[fold != k] - y[fold != k].mean(0)))
        out[fold == k] = y[fold != k].mean(0) + b @ w
    want = [np.corrcoef(y[:, k], out[:, k])[0, 1] for k in range(9)]
    assert [r[k] for k in range(9)] == pytest.approx(want)
    margin = ridge.alpha_margin(ridge.loo_errors(rows, ridge.moments(rows, np.zeros(p)), np.zeros(p), range(5)))
    assert {k: v[0] for k, v in margin.items()} == penalties and all(v[2] >= 0 for v in margin.values())


def test_builds_and_loaders(spark, tmp_path):
    slides = spark.createDataFrame([("p1", 1, "A", [1.0]), ("p1", 2, "A", [3.0]), ("p2", 3, "B", [5.0]), ("p3", 4, "A", [7.0])], "patient_id string, slide int, cancer_type string, vector array<double>")
    expr = spark.createDataFrame([(s, p, g, v) for s, p, a in (("p1-1", "p1", 1.0), ("p1-2", "p1", 3.0), ("p3-1", "p3", 8.0)) for g, v in (("g1", a), ("g2", -a))], "sample string, patient_id string, gene string, value double")
    sets = tables.example_gene_sets(spark).unionByName(tables.gene_sets(spark, {"mine": ["g1", "gone"]}))
    cohort, own = build.build_cohort(slides, expr, sets, "slide", types=["A"])
    rows = {r["patient_id"]: r for r in cohort.collect()}
    assert set(rows) == {"p1", "p3"} and rows["p1"]["vector"] == [2.0] and rows["p1"]["n_slides"] == 2 and rows["p3"]["SIG_mine"] == pytest.approx(math.sqrt(0.5))
    assert "SIG_CYTOLYTIC" not in cohort.columns and own.filter("sample = 'p1' AND gene = 'g1'").first()["value"] == 2.0
    first, own = build.build_cohort(slides, expr, sets, "slide", how="first")
    assert own.filter("sample = 'p1' AND gene = 'g1'").first()["value"] == 1.0
    tables.write_provenance([tables.Provenance("x", "here", n_rows=3)], str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text())[0]["n_rows"] == 3
    assert spark.range(1).select(stats.inv_fisher_z(stats.fisher_z(F.lit(0.3)))).first()[0] == pytest.approx(0.3)


def test_ladders_of_several_scores_and_covariates(spark):
    rng = np.random.default_rng(9)
    rows = [(float(rng.normal() + i % 4), float(rng.normal()), float(i % 4 + rng.normal()), f"s{i % 4}", i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, pred double, site string, fold int")
    t = variance.decompose_all(df, [("b", "pred"), ("a", "pred")], [("M0", []), ("M1", ["site"])], ["site"])
    assert set(t["signature"]) == {"a", "b"} and t["incremental_image_r2"].is_monotonic_decreasing and t["n_ladder"].eq(120).all()
    assert audit.covariate_baseline(df, "a", ["site"], ["site"], 3) == pytest.approx(variance.out_of_fold_r2(df, "a", ["site"], ["site"], n_folds=3)) and audit.covariate_baseline(df, "a", ["site"], ["site"], 3) > 0.3


def test_panels_and_rescoring(spark):
    rng = np.random.default_rng(10)
    own = rng.normal(size=80)
    e = rng.normal(size=(80, 30))
    e[:, :10] += 2 * own[:, None]
    expr = spark.createDataFrame([(i, j, float(e[i, j])) for i in range(80) for j in range(30)], "sample long, gene int, value double")
    sets = spark.createDataFrame([("own", j) for j in range(10)], "set_name string, gene int")
    table, rho = compare.panel_bracket(expr, sets, (3, 6, 10, 40))
    assert {r["k"]: r["n_sets"] for r in table.collect()} == {3: 1, 6: 1, 10: 1} and all(r["median_gap"] > 0.2 for r in table.collect()) and rho.first()["spearman"] is not None
    cohort = spark.createDataFrame([(i, 1.0) for i in range(82)], "patient_id long, own double")
    got = compare.rescore(cohort, expr, sets, "plage", ["own"])
    want = {r["sample"]: r["score"] for r in scoring.score_plage(expr, sets).collect()}
    assert all(r["own"] == (pytest.approx(want[r["patient_id"]]) if r["patient_id"] in want else None) for r in got.collect()) and got.count() == 82


def test_derived_columns_of_a_stacked_cohort(spark):
    """A cohort without p and q gets them from its interval, one that has them keeps them; sets of another cohort play no part."""
    import math

    rows = [("a", 0.5, 0.3, 0.7, True), ("b", 0.1, -0.1, 0.3, False), ("c", -0.6, -0.8, -0.4, False), ("d", 0.0, -0.2, 0.2, False)]
    old = spark.createDataFrame(rows, "set_name string, excess_z double, lo double, hi double, beats_null boolean")
    new = old.limit(1).select("*", F.lit(0.7).alias("p"), F.lit(0.8).alias("q"), F.lit(True).alias("beats_null_bh"))
    got = {(r["cohort"], r["set_name"]): r for r in compare.stack_excess({"new": new, "old": old}).collect()}
    assert len(got) == 5 and (got["new", "a"]["p"], got["new", "a"]["q"]) == (0.7, 0.8)
    for name, x, lo, hi, _ in rows:
        p = math.erfc(abs(x) / ((hi - lo) / (2 * 1.959963984540054)) / math.sqrt(2))
        assert got["old", name]["p"] == float(f"{p:.6g}")
    assert got["old", "a"]["beats_null_bh"] and not got["old", "c"]["beats_null_bh"] and got["old", "d"]["p"] == 1.0


def test_patients_are_counted_at_the_last_step_that_a_row_of_theirs_reaches(spark):
    from specaudit.operators import triage

    rows = [("p1", 1, 1), ("p1", 1, 0), ("p2", 0, 1), ("p3", 1, None), (None, 1, 1), ("p2", None, 1)]
    df = spark.createDataFrame(rows, "p string, a int, b int")
    got = [tuple(r) for r in triage.attrition(df, [("a", F.col("a") == 1), ("b", F.col("b") == 1)], "p").orderBy("place").collect()]
    assert got == [("all", 0, 6, 3), ("a", 1, 4, 2), ("b", 2, 2, 1)]
    assert triage.attrition(df.limit(0), [("a", F.col("a") == 1)], "p").select("n_rows", "n_patients").distinct().collect() == [(0, 0)]
