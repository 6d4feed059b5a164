"""Sums by levels, leading eigenvectors, many logistic models, hazards by ranges and ridge by classes of targets, against plain algebra."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from specaudit.functions import blocks, dealing, ranking
from specaudit.operators import axis, batch, compare, groups, hazard, logistic, nulls, outcome, ridge, scoring, spectra, variance


def test_tree_sums_add_up_all_parts(spark):
    rng = np.random.default_rng(0)
    rows = [(k, part, rng.normal(size=5)) for part in range(23) for k in ("a", "b") if not (k == "b" and part % 3)]
    df = spark.createDataFrame([(k, p, bytearray(blocks.packed(v))) for k, p, v in rows], "k string, part long, block binary")
    for fan_in, n_parts in ((2, 23), (5, 23), (64, 23), (2, 3), (2, 100)):  # also where the number of parts is wrong
        rows_ = blocks.tree_sum(df, ["k"], n_parts, fan_in).collect()
        assert len(rows_) == 2
        got = {r["k"]: np.frombuffer(r["block"]) for r in rows_}
        for k in ("a", "b"):
            np.testing.assert_allclose(got[k], sum(v for n, _, v in rows if n == k))
    m = rng.normal(size=(7, 9))
    np.testing.assert_array_equal(blocks.joined(blocks.cut(m, 10)).reshape(7, 9), m)
    assert blocks.count_parts(spark.range(100, numPartitions=3)) == 3 and blocks.count_parts(spark.range(0)) >= 1


def long_table(spark, x, sample="long"):
    rows = [(i, f"g{j:03d}", None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, f"sample {sample}, gene string, value double").repartition(3)


def plain_axis(x):
    with np.errstate(invalid="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        s = np.nanstd(x, axis=0, ddof=1)
        z = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.where(s > 0, s, np.nan))
    u, d, _ = np.linalg.svd(z, full_matrices=False)
    a = u[:, 0] * d[0]
    return (a if a @ z.mean(1) >= 0 else -a), d[0] ** 2 / (d**2).sum()


@pytest.mark.parametrize("gram_members", [1024, 4])
def test_first_axis_equals_the_singular_vector(spark, monkeypatch, gram_members):
    """By cross products, and by Lanczos steps of three blocks that start again; missing values, a constant and an empty gene."""
    monkeypatch.setattr(spectra.leading, "__defaults__", (gram_members, 1e-12, 500))
    monkeypatch.setattr(spectra, "BASIS", 6)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 12)) + rng.normal(size=(90, 1)) * np.linspace(0.5, 2, 12)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 3], x[:, 4] = 5.0, np.nan
    group = np.arange(90) % 3
    group[group == 2] = np.where(np.arange(30) < 25, 1, 2)  # the third has five samples
    g = spark.createDataFrame([(i, int(v)) for i, v in enumerate(group)], "sample long, group int")
    got = {r["sample"]: r for r in axis.global_axis_pc1(long_table(spark, x), g).collect()}
    assert set(got) == set(np.flatnonzero(group < 2).tolist())
    for k in (0, 1):
        at = np.flatnonzero(group == k)
        want, share = plain_axis(x[at])
        np.testing.assert_allclose([got[i]["axis"] for i in at.tolist()], want, atol=1e-7)
        assert {r["group"] for r in (got[i] for i in at.tolist())} == {str(k)}
        assert got[int(at[0])]["variance_explained"] == pytest.approx(share, abs=1e-9)
    whole = {r["sample"]: r["axis"] for r in axis.global_axis_pc1(long_table(spark, x, "string")).collect()}
    np.testing.assert_allclose([whole[str(i)] for i in range(90)], plain_axis(x)[0], atol=1e-7)
    assert axis.global_axis_pc1(long_table(spark, x[:0])).count() == 0


def test_no_task_takes_a_group(spark):
    plan = axis.global_axis_pc1(long_table(spark, np.random.default_rng(0).normal(size=(20, 4))))._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("gram_members", [1024, 2])
def test_plage_equals_the_singular_vector(spark, monkeypatch, gram_members):
    monkeypatch.setattr(spectra.leading, "__defaults__", (gram_members, 1e-12, 500))
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 9)) + rng.normal(size=(40, 1))
    x[5, 2] = np.nan  # its gene drops out
    sets = spark.createDataFrame([("a", f"g{j:03d}") for j in range(5)] + [("b", f"g{j:03d}") for j in range(4, 9)] + [("c", "g002"), ("d", "none")], "set_name string, gene string")
    got = {}
    for r in scoring.score_plage(long_table(spark, x), sets).collect():
        got.setdefault(r["set_name"], {})[r["sample"]] = r["score"]
    assert set(got) == {"a", "b"}
    z = (x - np.nanmean(x, 0)) / np.nanstd(x, 0, ddof=1)
    for s, genes in (("a", [0, 1, 3, 4]), ("b", [4, 5, 6, 7, 8])):
        u = np.linalg.svd(z[:, genes], full_matrices=False)[0][:, 0]
        u = u if u @ z[:, genes].mean(1) >= 0 else -u
        np.testing.assert_allclose([got[s][i] for i in range(40)], u, atol=1e-8)


def test_sums_are_handed_on_when_many_groups_meet(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 6))
    sets = spark.createDataFrame([(f"s{k}", f"g{(k + j) % 6:03d}") for k in range(6) for j in range(4)], "set_name string, gene string")
    want = {(r["sample"], r["set_name"]): r["score"] for r in scoring.score_plage(long_table(spark, x), sets).collect()}
    monkeypatch.setattr(spectra, "HELD_BYTES", 200)
    got = {(r["sample"], r["set_name"]): r["score"] for r in scoring.score_plage(long_table(spark, x), sets).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9


def newton_logistic(x, y, c=1.0):
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = np.r_[0.0, np.full(x.shape[1], 1 / c)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-12:
            break
    return w


def sites_table(spark, n=240, seed=4):
    rng = np.random.default_rng(seed)
    site = np.where(np.arange(n) < 0.7 * n, 0, np.where(np.arange(n) < 0.9 * n, 1, 2))
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 1] + [0, 100, 0, 3]
    x[:, 0] += 4.0 * (site == 2)  # nearly separable, and rare
    x[:, 3] = 3.0  # without variance
    fold = rng.permutation(n) % 4
    rows = [(i, int(site[i]) if i % 50 else None, int(fold[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "key long, site int, fold int, x array<double>").repartition(3), x, np.array([-1 if i % 50 == 0 else site[i] for i in range(n)]), fold


@pytest.mark.parametrize("model_bytes", [64 << 20, 300])
def test_models_by_common_scans_equal_single_fits(spark, monkeypatch, model_bytes):
    monkeypatch.setattr(logistic, "MODEL_BYTES", model_bytes)
    df, x, site, fold = sites_table(spark)
    auc = {r["site"]: (r["n_patients"], r["auroc"]) for r in batch.site_prediction_control(df, 4).collect()}
    assert set(auc) == {0, 1, 2}
    for s in auc:
        score = np.zeros(len(x))
        for k in range(4):
            tr = fold != k
            m, d = x[tr].mean(0), x[tr].std(0)
            d = np.where(d > 1e-12, d, 1.0)
            w = newton_logistic((x[tr] - m) / d, (site[tr] == s).astype(float))
            score[~tr] = (x[~tr] - m) / d @ w[1:] + w[0]
        pos, neg = score[site == s], score[site != s]
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert auc[s][0] == len(pos) and auc[s][1] == pytest.approx(want, abs=1e-9)


def test_score_equation_holds_at_the_weights(spark):
    df, x, site, fold = sites_table(spark, seed=5)
    held = df.select(F.coalesce("site", F.lit(-1)).alias("label"), F.col("fold").cast("long").alias("fold"), "x").persist()
    centre = ridge.feature_means(held)
    share = [(s, k, float((site[fold != k] == s).mean())) for s in (0, 2) for k in range(4)]
    fitted = logistic.fit(held, share, logistic.fold_products(held, centre, blocks.count_parts(held)), centre, blocks.count_parts(held))
    for (s, k), (w, b) in fitted.items():
        tr = fold != k
        d = np.where(x[tr].std(0) > 1e-12, x[tr].std(0), 1.0)
        r = 1 / (1 + np.exp(-(x[tr] @ w + b))) - (site[tr] == s)
        assert abs(r.sum()) < 1e-5 and np.abs((x[tr] - x[tr].mean(0)).T @ r / d + w * d).max() < 1e-5
    held.unpersist()


def test_combat_says_what_it_could_estimate(spark):
    df, _, site, _ = sites_table(spark)
    lone = df.filter("site IS NOT NULL").withColumn("fold", F.when(F.col("site") == 2, 0).otherwise(F.col("fold")))  # all of a site in one fold
    r = {x["site"]: (x["estimable"], x["auroc"]) for x in batch.site_prediction_control_oof_combat(lone, 4).collect()}
    assert r[0][0] == 1.0 and r[2] == (0.0, None)  # its fold has no model, and no other fold a patient of it
    assert {x["site"]: x["estimable"] for x in batch.site_prediction_control_oof_combat(df.filter("site IS NOT NULL"), 4).collect()}[2] == 1.0


@pytest.mark.parametrize("range_rows", [6, 1000])
def test_hazards_by_ranges_equal_newton(spark, range_rows):
    """Ties, within a range and across several, events and others at one time, and rows that repeat."""
    rng = np.random.default_rng(6)
    n = 80
    x = np.round(rng.normal(size=(n, 2)), 1)
    time = rng.integers(1, 12, n).astype(float)
    time[:25] = 4.0
    event = (rng.random(n) < 0.6).astype(float)
    x[30:34], time[30:34], event[30:34] = x[30], 4.0, 1.0
    df = spark.createDataFrame([(float(t), float(e), float(a), float(b)) for t, e, (a, b) in zip(time, event, x, strict=True)], "time double, event double, a double, b double")
    want = outcome.newton(time, event, x)
    rows = hazard.in_ranges(df, ["a", "b"], range_rows).persist()
    assert rows.select("part").distinct().count() > (1 if range_rows < 100 else 0)
    got = hazard.newton(rows, 2)
    rows.unpersist()
    np.testing.assert_allclose(got[0], want[0], atol=1e-8)
    np.testing.assert_allclose(got[1], want[1], rtol=1e-7)
    same = df.withColumn("time", F.lit(3.0))
    got, want = hazard.newton(hazard.in_ranges(same, ["a"], range_rows).persist(), 1), outcome.newton(np.full(n, 3.0), event, x[:, :1])
    np.testing.assert_allclose(got[0], want[0], atol=1e-8)
    assert hazard.newton(hazard.in_ranges(df.limit(0), ["a"]), 1) is None


def test_ranks_of_values_in_ranges(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(k), float(v), bool(f)) for k, v, f in zip(rng.integers(0, 2, 400), rng.integers(0, 40, 400), rng.random(400) < 0.4, strict=True)]
    df = spark.createDataFrame(rows, "k int, v double, f boolean")
    whole = [sorted(map(tuple, compare.mann_whitney(df, "v", F.col("f"), *keys).collect())) for keys in ((), ("k",))]
    monkeypatch.setattr(ranking, "SMALL", 30)
    assert len(ranking.boundaries(df, "v")) > 5
    for keys, want in zip(((), ("k",)), whole, strict=True):
        np.testing.assert_allclose(sorted(map(tuple, compare.mann_whitney(df, "v", F.col("f"), *keys).collect())), want, rtol=1e-9)


@pytest.mark.parametrize("held", [64 << 20, 100])
def test_ridge_with_a_pattern_of_missing_targets_in_every_row(spark, monkeypatch, held):
    monkeypatch.setattr(ridge, "HELD_BYTES", held)
    rng = np.random.default_rng(8)
    n, p, t = 300, 4, 14
    x, y = rng.normal(size=(n, p)), rng.normal(size=(n, t))
    y[:, :p] += x
    y[rng.random((n, t)) < 0.3] = np.nan
    y[:, 5], y[:, 6] = y[:, 4], np.where(np.isnan(y[:, 4]), np.nan, 1.0 + y[:, 4])  # three of one class
    y[:, 7] = rng.normal(size=n)  # and one without missing values
    fold = np.arange(n) % 3
    df = spark.createDataFrame([(i, int(fold[i]), [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(n)], "key long, fold int, x array<double>, y array<double>").repartition(4)
    classes = ridge.target_classes(df)
    assert classes[7] == 0 and classes[4] == classes[5] == classes[6] != 0 and len(set(classes)) == t - 2
    assert len(np.unique(np.isnan(y), axis=0)) > 200
    got = {(r["key"], r["target"]): r["y_pred"] for r in ridge.cross_val_predict(df, [str(j) for j in range(t)], 3, alpha=2.0).collect()}
    assert len(got) == (~np.isnan(y)).sum()
    for j in range(t):
        for k in range(3):
            tr, te = (fold != k) & ~np.isnan(y[:, j]), (fold == k) & ~np.isnan(y[:, j])
            m, s = x[tr].mean(0), x[tr].std(0)
            z = (x[tr] - m) / s
            beta = np.linalg.solve(z.T @ z + 2.0 * np.eye(p), z.T @ (y[tr, j] - y[tr, j].mean()))
            np.testing.assert_allclose([got[int(i), str(j)] for i in np.flatnonzero(te)], (x[te] - m) / s @ beta + y[tr, j].mean(), atol=1e-8)


def test_medians_by_narrowing_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=301), rng.integers(-2, 3, 301), np.zeros(301), -np.exp(rng.normal(size=301) * 200), rng.normal(size=301)])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = np.nan
    x[7, 2], x[8, 2] = -0.0, np.inf
    for n in (301, 2, 1):
        df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r],) for r in x[:n]], "x array<double>").repartition(4)
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            want = np.nan_to_num(np.nanmedian(x[:n], axis=0))
        np.testing.assert_array_equal(ridge.narrowed_medians(df), want)
        monkeypatch.setattr(ridge, "MEDIAN_ROWS", 1)
        assert [r["median"] for r in ridge.impute_medians(df).orderBy("pos").collect()] == want.tolist()
        monkeypatch.setattr(ridge, "MEDIAN_ROWS", 100_000)
    assert not len(ridge.narrowed_medians(df.limit(0)))


def test_sparse_least_squares_equals_dense(spark):
    """Nested and crossed factors, a missing level, a number without variance; and a factor with very many levels."""
    rng = np.random.default_rng(10)
    n = 400
    site = rng.integers(0, 12, n)
    kind, plate, u, v = site // 4, rng.integers(0, 9, n), rng.normal(size=n), np.full(n, 2.5)
    y = 0.3 * site - kind + u + rng.normal(size=n) + 1e4
    rows = [(f"s{a}" if a else None, int(b), int(c), float(d), float(e), float(f), float(f + g)) for a, b, c, d, e, f, g in zip(site, kind, plate, u, v, y, rng.normal(size=n), strict=True)]
    df = spark.createDataFrame(rows, "site string, kind int, plate int, u double, v double, y double, pred double")
    g = variance.sums(df, ["kind", "site", "plate", "u", "v"], ["kind", "site", "plate"], ["y", "pred"])

    def dense(*terms):
        columns = [np.ones(n)]
        for t in terms:
            a = {"site": site, "kind": kind, "plate": plate, "u": u, "v": v}[t]
            columns += [a] if t in "uv" else [(a == k).astype(float) for k in np.unique(a)[1:]]
        x = np.column_stack(columns)
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        return 1 - rest @ rest / ((y - y.mean()) ** 2).sum()

    for terms in (["kind"], ["kind", "site"], ["site", "plate", "u"], ["u"], ["kind", "site", "plate", "u", "v"]):
        assert g.r2(terms, "y")[0] == pytest.approx(dense(*terms), abs=1e-9), terms
    assert g.r2(["v"], "y") == (0.0, 0.0, 1) and g.r2([], "y") == (0.0, 0.0, 1)
    assert g.r2(["kind", "site"], "y")[2] == 1 + 2 + 11
    ladder = variance.decompose_all(df, [("y", "pred"), ("u", "pred")], [("M0", []), ("M1", ["kind"]), ("M2", ["kind", "site"])], ["kind", "site"])
    one = variance.r2_ladder(df, "y", "pred", [("M0", []), ("M1", ["kind"]), ("M2", ["kind", "site"])], ["kind", "site"]).set_index("model")["r2"]
    own = ladder.set_index("signature").loc["y"]
    assert all(own[m] == pytest.approx(one[m]) for m in ("M0", "M1", "M2", "Mfull", "Image_only"))
    many = spark.range(400_000).select((F.col("id") % 100_000).alias("site"), (F.col("id") % 100_000 % 500).alias("kind"), (F.col("id") % 7 + F.col("id") % 100_000 / 1000.0).alias("y"))
    s = variance.sums(many, ["kind", "site"], ["kind", "site"], ["y"])
    single = variance.single_factor_r2(many, "y", "site").first()
    got = s.r2(["kind", "site"], "y")
    assert got[0] == pytest.approx(single["r2"], abs=1e-9) and got[2] == 1 + 499 + 99_999


def test_keyed_permutations_are_permutations():
    for n in [*range(1, 40), 97, 1000]:
        for key in (0, 1, 2**31 - 1):
            assert sorted(dealing.dealt_places(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))
    # all orders of three come up alike, and any place goes anywhere
    keys = np.arange(6000) * dealing.DRAW_STEP % dealing.KEYS
    images = [dealing.dealt_places(np.full(6000, p), np.full(6000, 3), keys) for p in range(3)]
    orders = np.unique(np.stack(images, 1), axis=0, return_counts=True)[1]
    assert len(orders) == 6 and orders.min() > 850
    to = np.bincount(dealing.dealt_places(np.full(20_000, 5), np.full(20_000, 50), np.arange(20_000) * dealing.DRAW_STEP % dealing.KEYS), minlength=50)
    assert ((to - 400) ** 2 / 400).sum() < 90  # chi2 with 49 degrees of freedom
    assert not len(dealing.dealt_places(np.zeros(0), np.zeros(0), np.zeros(0)))


def test_labels_are_dealt_within_strata(spark):
    df = spark.createDataFrame([(i, f"l{i % 5}", "a" if i < 30 else "b") for i in range(50)], "k int, label string, kind string")
    for within in (None, "kind"):
        got = groups.permuted(df, "k", "label", 7, within=within)
        plan = got._jdf.queryExecution().toString()
        assert plan.count("row_number") <= 8 and "md5(concat_ws(|, 0, cast(perm" not in plan
        rows = got.collect()
        for perm in range(7):
            own = {r["k"]: r["label"] for r in rows if r["perm"] == perm}
            assert sorted(own) == list(range(50))
            for part in (range(30), range(30, 50)) if within else (range(50),):
                assert sorted(own[k] for k in part) == sorted(f"l{k % 5}" for k in part)
            assert sum(own[k] == f"l{k % 5}" for k in own) < 30


def test_random_sets_keep_levels_and_fill_up(spark):
    genes = spark.range(100).select(F.col("id").alias("gene"), (F.col("id") % 10).cast("int").alias("bin"))
    sets = spark.createDataFrame([("a", g) for g in range(30)] + [("b", g) for g in (0, 10, 20) * 6], "set_name string, gene long")
    rows = nulls.random_sets(sets, genes, 20).collect()
    for draw in range(20):
        a = [r["gene"] for r in rows if r["set_name"] == "a" and r["draw"] == draw]
        b = [r["gene"] for r in rows if r["set_name"] == "b" and r["draw"] == draw]
        assert len(set(a)) == 30 and np.bincount([g % 10 for g in a]).tolist() == [3] * 10
        assert len(set(b)) == 18 and {g for g in range(0, 100, 10)} <= set(b)  # the whole bin, and eight of all others
    assert len({tuple(sorted(r["gene"] for r in rows if r["set_name"] == "a" and r["draw"] == d)) for d in range(20)}) == 20
    with pytest.raises(ValueError, match="half of the pool"):
        nulls.random_sets(sets, genes, 1, pool=spark.range(201).select(F.col("id").alias("gene")))
    assert nulls.random_sets(sets, genes, 2, matched=False, pool=spark.range(1000).select(F.col("id").alias("gene"))).filter("gene >= 100").count() > 50
