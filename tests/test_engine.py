"""Kernels against NumPy, distribution functions against known values, and edges of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from specaudit.functions import special, stats
from specaudit.operators import axis, batch, cohort, groups, inference, nulls, outcome, ridge, scoring, splits, variance
from specaudit.plans import sweep
from specaudit.sources import barcodes, tables
from specaudit.streaming import moments


def test_distributions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_ppf(0.95, 10) == pytest.approx(18.307038053275146, abs=1e-8)
    assert special.f_ppf(0.95, 3, 10) == pytest.approx(3.708264819663104, abs=1e-8)
    assert special.two_sided_p(1.959963984540054, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.hypergeometric_tail(3, 10, 4, 5) == pytest.approx((math.comb(4, 3) * math.comb(6, 2) + math.comb(6, 1)) / math.comb(10, 5))
    assert special.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857142857)
    assert special.normal_power(0.0, 1.0) == pytest.approx(0.05)
    assert special.relabelling_p([3.0, 2.0, 1.0, 0.0], [True, True, False, False]) == (2.0, pytest.approx(1 / 6))


def test_concordance_kernel_equals_pairs():
    rng = np.random.default_rng(1)
    t, e, s = rng.integers(1, 30, 200).astype(float), rng.integers(0, 2, 200).astype(float), rng.integers(0, 20, 200).astype(float)
    won = pairs = 0
    for i in range(200):
        for j in range(200):
            if e[i] == 1 and t[j] > t[i]:
                pairs += 1
                won += 1 if s[j] < s[i] else 0.5 * (s[j] == s[i])
    assert outcome.count_concordant(t, e, s) == (won, pairs)


def test_cox_recovers_a_planted_hazard(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    t = rng.exponential(np.exp(-0.7 * x))
    df = spark.createDataFrame([(float(a), 1.0, float(b)) for a, b in zip(t, x, strict=True)], "time double, event double, score double")
    r = outcome.cox(df)
    assert r["coef"] == pytest.approx(0.7 * x.std(), abs=0.15) and r["p"] < 1e-6 and r["n_events"] == 400
    assert math.isnan(outcome.cox(df.limit(5))["hr"])


def _rows(rng, n=120, p=4, q=2):
    x = rng.normal(size=(n, p)) + 3
    y = x @ rng.normal(size=(p, q)) + rng.normal(size=(n, q))
    return x, y, np.arange(n) % 3


def _frame(spark, x, y, fold):
    return spark.createDataFrame([(i, int(fold[i]), [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(len(x))], "key long, fold int, x array<double>, y array<double>")


def _ridge(x, y, a):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    b = np.linalg.solve(z.T @ z + a * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return b / s, y.mean() - m @ (b / s)


def test_ridge_equals_numpy_with_missing_targets_and_features(spark):
    rng = np.random.default_rng(3)
    x, y, fold = _rows(rng)
    y[rng.random(len(y)) < 0.2, 1] = np.nan
    x[rng.random(x.shape) < 0.05] = np.nan
    got = {(r["key"], r["target"]): r["y_pred"] for r in ridge.cross_val_predict(_frame(spark, x, y, fold), ["a", "b"], 3, alpha=5.0).collect()}
    for k in range(3):
        filled = np.where(np.isnan(x), np.nanmedian(x[fold != k], axis=0), x)
        for t, name in enumerate("ab"):
            ok = (fold != k) & ~np.isnan(y[:, t])
            b, c = _ridge(filled[ok], y[ok, t], 5.0)
            for i in np.flatnonzero((fold == k) & ~np.isnan(y[:, t])):
                assert got[i, name] == pytest.approx(filled[i] @ b + c, abs=1e-8)
    assert len(got) == int((~np.isnan(y)).sum())


def test_loo_errors_equal_refits(spark):
    rng = np.random.default_rng(4)
    x, y, fold = _rows(rng, n=45)
    f = _frame(spark, x, y, fold)
    c = np.zeros(4)
    e = ridge.loo_errors(f, ridge.moments(f, c), c, [0], 0, [0.5, 20.0])[0]
    tx, ty = x[fold != 0], y[fold != 0, 0]
    m, s = tx.mean(0), tx.std(0)
    z = (tx - m) / s
    for a, err in zip([0.5, 20.0], e, strict=True):
        total = 0.0
        for i in range(len(z)):
            keep = np.arange(len(z)) != i
            zi, yi = z[keep], ty[keep]
            d = zi - zi.mean(0)
            b = np.linalg.solve(d.T @ d + a * np.eye(4), d.T @ (yi - yi.mean()))
            total += (ty[i] - yi.mean() - (z[i] - zi.mean(0)) @ b) ** 2
        assert err == pytest.approx(total / len(z), rel=1e-8)


def test_pc1_and_plage(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=60)
    e = np.outer(a, rng.uniform(0.5, 1, 20)) + 0.3 * rng.normal(size=(60, 20))
    df = spark.createDataFrame([(i, j, float(e[i, j])) for i in range(60) for j in range(20)], "sample long, gene int, value double")
    z = (e - e.mean(0)) / e.std(0, ddof=1)
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    want = u[:, 0] * s[0] * np.sign(u[:, 0] @ z.mean(1))
    got = {r["sample"]: r for r in axis.global_axis_pc1(df).collect()}
    assert np.allclose([got[i]["axis"] for i in range(60)], want) and got[0]["variance_explained"] == pytest.approx(s[0] ** 2 / (s**2).sum())
    sets = spark.createDataFrame([("all", j) for j in range(20)], "set_name string, gene int")
    plage = {r["sample"]: r["score"] for r in scoring.score_plage(df, sets).collect()}
    assert np.allclose([plage[i] for i in range(60)], want / s[0])
    with pytest.raises(ValueError):
        scoring.score_sets(df, sets, "none")


def test_ssgsea_equals_the_walk(spark):
    rng = np.random.default_rng(6)
    e = rng.integers(0, 6, (5, 30)).astype(float)
    members = [1, 4, 7, 20]
    df = spark.createDataFrame([(i, j, float(e[i, j])) for i in range(5) for j in range(30)], "sample long, gene int, value double")
    got = {r["sample"]: r["score"] for r in scoring.score_ssgsea(df, spark.createDataFrame([("s", j) for j in members], "set_name string, gene int")).collect()}
    for i in range(5):
        v = e[i]
        rank = np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
        order = np.argsort(-v, kind="stable")
        hit = np.isin(order, members)
        w = np.abs(rank[order]) ** 0.25
        walk = np.cumsum(np.where(hit, w, 0)) / w[hit].sum() - np.cumsum(~hit) / (~hit).sum()
        assert got[i] == pytest.approx(walk.sum() / 30, abs=1e-10)


def test_ladder_equals_least_squares(spark):
    rng = np.random.default_rng(7)
    n = 150
    site, kind, u = rng.integers(0, 6, n), rng.integers(0, 3, n), rng.normal(size=n)
    p = rng.normal(size=n)
    y = site * 0.3 + kind + u + 0.5 * p + rng.normal(size=n)
    df = spark.createDataFrame([(float(y[i]), float(p[i]), float(u[i]), f"k{kind[i]}", f"s{site[i]}", i % 3) for i in range(n)], "y double, p double, u double, kind string, site string, fold int")
    t = variance.r2_ladder(df, "y", "p", [("M0", []), ("M1", ["u"]), ("M2", ["u", "kind"]), ("M3", ["u", "kind", "site"])], ["kind", "site"]).set_index("model")
    dummies = lambda c: np.column_stack([c == v for v in sorted(set(c))[1:]]).astype(float)
    x = np.column_stack([np.ones(n), u, dummies(kind), dummies(site), p])

    def r2(cols):
        b = np.linalg.lstsq(x[:, cols], y, rcond=None)[0]
        return 1 - ((y - x[:, cols] @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    assert t.loc["M1", "r2"] == pytest.approx(r2([0, 1])) and t.loc["M3", "r2"] == pytest.approx(r2(list(range(9)))) and t.loc["Mfull", "r2"] == pytest.approx(r2(list(range(10))))
    assert variance.incremental_r2(t.reset_index()) == pytest.approx(t.loc["Mfull", "adj_r2"] - t.loc["M3", "adj_r2"])
    assert variance.out_of_fold_r2(df, "y", ["u", "kind"], ["kind"], n_folds=3) < r2([0, 1, 2, 3])
    v = variance.label_site_variance(df, ["y"], "site", "kind", "u", "kind")
    assert v["r2_site_given_type"][0] > 0
    with pytest.raises(ValueError):
        variance.label_site_variance(df, ["y"], "site", min_site_n=1000)


def test_sites_stay_whole_and_degenerate_folds_raise(spark):
    rows = spark.createDataFrame([(f"P{i}", f"S{i % 20}", float(i)) for i in range(200)], "patient_id string, site string, y double")
    s = splits.preserved_site_split(rows, "site", outcome="y")
    splits.assert_site_disjoint(rows, s.folds, "site")
    assert s.folds.count() == 200
    with pytest.raises(ValueError):
        splits.preserved_site_split(rows.filter("site IN ('S1', 'S2')"), "site")
    skew = rows.withColumn("site", F.when(F.col("y") < 190, "big").otherwise(F.col("patient_id")))
    with pytest.raises(splits.DegenerateSplit):
        splits.preserved_site_split(skew, "site")
    good, bad = splits.repeated_site_splits(rows, "site", repeats=3)
    assert len(good) + len(bad) == 3
    uneven = rows.withColumn("site", F.when(F.col("y") < 50, "big").otherwise(F.col("site")))
    sizes = uneven.join(splits.group_kfold(uneven, "site"), "site").groupBy("fold").count().collect()
    assert sum(r["count"] for r in sizes) == 200
    with pytest.raises(AssertionError):
        splits.assert_site_disjoint(rows, rows.select(F.col("patient_id").alias("key"), F.floor(F.col("y") / 100).cast("int").alias("fold")), "site")


def test_undefined_values_stay_null(spark):
    one = spark.range(1)
    null = F.lit(None).cast("double")
    r = one.select(stats.fisher_z(null).alias("a"), stats.disattenuate(F.lit(0.5), F.lit(0.005)).alias("b"), stats.disattenuate(F.lit(0.9), F.lit(0.5)).alias("c"), stats.number(F.lit("x")).alias("d"), stats.number(F.lit("NaN")).alias("e"), stats.clip(null, 0.0, 1.0).alias("f")).first()
    assert all(v is None for v in r)
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "x double, y double")
    assert flat.agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] is None
    few = spark.createDataFrame([("s", 0.1), ("s", 0.2)], "set_name string, r double")
    seen = spark.createDataFrame([("s", 0.5, 100)], "set_name string, r double, n long")
    assert nulls.excess_over_null(seen, few).first()["excess_z"] is None


def test_barcodes_and_loaders(spark, tmp_path):
    df = spark.createDataFrame([(" tcga-05-4244-01A-11R-A1B2-07 ", None), ("x", "TCGA-06-0001-01.svs"), ("bad-but-long-code", "TCGA-06-0002-01.svs"), (None, "junk")], "barcode string, filename string")
    v = df.withColumn("embedding", F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))))
    got = {r["patient_id"]: r for r in tables.load_embeddings(v).collect()}
    assert set(got) == {"TCGA-05-4244", "TCGA-06-0001"} and got["TCGA-05-4244"]["vector"] == [3.0, 4.0] and got["TCGA-05-4244"]["plate"] == "A1B2"
    with pytest.raises(Exception, match="malformed"):
        barcodes.annotate(df.filter("barcode = 'x'"), drop_unparseable=False).collect()
    gmt = tmp_path / "a.gmt"
    gmt.write_text("A\td\tg1\tg2\nB\td\tg3\n")
    sets = tables.read_gene_sets_gmt(spark, str(gmt))
    assert [tuple(r) for r in sets.orderBy("set_name", "ordinal").collect()] == [("A", 0, "g1"), ("A", 1, "g2"), ("B", 0, "g3")]
    kept, report = tables.filter_sets(sets, spark.createDataFrame([("g1",), ("g2",)], "gene string"), 2)
    assert {r["set_name"] for r in kept.collect()} == {"A"} and report.count() == 2
    js = tmp_path / "a.json"
    js.write_text('{"A": ["g1", "g2"]}')
    assert tables.read_gene_sets_json(spark, str(js)).count() == 2
    tables.write_gene_sets_json(sets, str(tmp_path / "b.json"))
    assert sorted(map(tuple, tables.read_gene_sets_json(spark, str(tmp_path / "b.json")).collect())) == sorted(map(tuple, sets.collect()))
    csv = tmp_path / "a.tsv"
    csv.write_text("sample\tENSG1.2\tENSG2.1\nTCGA-05-4244-01A\t1.5\tx\nTCGA-05-4245-11A\t2\t3\n")
    wide = tables.read_delimited(spark, str(csv))
    genes = spark.createDataFrame([("ENSG1", "AA"), ("ENSG2", "AA")], "gene_id string, symbol string")
    assert [tuple(r) for r in tables.load_expression(wide, "sample", genes).collect()] == [("TCGA-05-4244-01", "AA", 0, 1.5)]
    assert tables.guess_column(["x", "Sample_ID"], ("sample",)) == "Sample_ID"
    with pytest.raises(ValueError):
        tables.guess_column(["x"], ("sample",))


def test_joins_that_would_add_rows_raise(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "patient_id long, v string")
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "patient_id long, w double")
    with pytest.raises(ValueError):
        cohort.assemble_cohort(a, {"t": twice})
    with pytest.raises(ValueError):
        cohort.inner_join_checked(a, twice, "patient_id")
    assert "CHECK" in cohort.coverage_report(cohort.assemble_cohort(a, {"t": twice.limit(1)}), {"t": ["w"]})


def test_confounded_groups_agree_within_strata(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1600):
        easy = rng.random() < (0.8 if i % 2 else 0.2)
        t = rng.normal()
        rows.append(("EUR" if i % 2 else "AFR", "EASY" if easy else "HARD", float(t), float(t + (0.3 if easy else 2.0) * rng.normal())))
    df = spark.createDataFrame(rows, "group string, stratum string, y_true double, y_pred double")
    crude = groups.contrast_vs_reference(groups.group_correlations(df)).filter("group = 'AFR'").first()
    fair = groups.with_heterogeneity(groups.stratified_contrast(df)).filter("group = 'AFR'").first()
    assert crude["delta_hi"] < 0 and fair["delta_lo"] < 0 < fair["delta_hi"] and not fair["heterogeneous"]


def test_combat_and_site_control(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 5))
    site = np.arange(120) % 3
    x[:, 0] += site * 3
    df = spark.createDataFrame([(i, int(site[i]), i // 3 % 4, [float(v) for v in x[i]]) for i in range(120)], "key long, site int, fold int, x array<double>")
    assert {r["site"]: r["auroc"] for r in batch.site_prediction_control(df, 4).collect()}[2] > 0.9
    assert batch.site_prediction_control(df, 4, min_site_n=1000).count() == 0
    long = df.select("key", F.col("site").alias("batch"), "fold", F.posexplode("x")).select("key", "batch", "fold", F.col("pos").alias("dim"), F.col("col").alias("value"))
    m = batch.combat(long).filter("dim = 0").groupBy("batch").agg(F.avg("corrected").alias("m")).collect()
    assert max(r["m"] for r in m) - min(r["m"] for r in m) < 1e-9


def test_inference(spark):
    assert inference.effective_tests(np.eye(4)) == pytest.approx(4)
    with pytest.raises(ValueError):
        inference.effective_tests(np.ones((2, 3)))
    df = spark.createDataFrame([(i % 30, float(i), float(i)) for i in range(300)], "c long, a double, b double")
    r = inference.paired_delta(df, "a", "b", "c", n_boot=50).first()
    assert r["value"] == r["lo"] == r["hi"] == 0 and r["n"] == 30
    assert math.isnan(inference.pooled_bootstrap(spark.createDataFrame([(1, [[1.0, 2.0]])], "key long, sets array<array<double>>"), {"s": (1.0, [])})["value"])


def test_sweep_conflicts_raise(spark):
    s = spark.createDataFrame([(1, 0.5, "a"), (1, 0.5, "b"), (2, 0.7, "a")], "split_seed long, isi double, source string")
    merged, missing = sweep.merge_shards(s, ["isi"], spark.range(1, 4).withColumnRenamed("id", "split_seed"))
    assert merged.count() == 2 and [r[0] for r in missing.collect()] == [3]
    with pytest.raises(ValueError):
        sweep.merge_shards(s.unionAll(spark.createDataFrame([(2, 0.8, "c")], s.schema)), ["isi"])
    runs = spark.createDataFrame([(i, 0.3 + i / 100, 0.2, 0.4) for i in range(5)], "split_seed long, isi double, lo double, hi double")
    e = sweep.combined_error(runs)
    assert e["se_total"] ** 2 == pytest.approx(e["se_boot"] ** 2 + e["sd"] ** 2)


def test_moments_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{i % 5}:10:00", "k", float(i)) for i in range(50)], "ts string, key string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = moments.windowed_moments(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "value", ["key"])
    q = stream.writeStream.outputMode("update").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    want = {r["window_start"]: (r["n"], round(r["sd"], 9)) for r in moments.windowed_moments(rows, "ts", "value", ["key"]).collect()}
    assert {r["window_start"]: (r["n"], round(r["sd"], 9)) for r in spark.table("windowed").collect()} == want


def test_manifest_statuses(spark, tmp_path):
    from specaudit.sources import manifest

    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    then = [tuple(r) for r in manifest.manifest(spark, str(tmp_path), "*.txt").collect()]
    old = spark.createDataFrame(then, "path string, sha256 string, length long")
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "b.txt").unlink()
    (tmp_path / "c.txt").write_text("new")
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in manifest.compare_manifests(old, manifest.manifest(spark, str(tmp_path), "*.txt")).collect()}
    assert got == {"a.txt": "CHANGED", "b.txt": "MISSING", "c.txt": "NEW"}
    assert manifest.fingerprint_status(None, "x") == "absent" and manifest.fingerprint_status("x", "x") == "match" and manifest.fingerprint_status("y", "x") == "mismatch"


def test_triage(spark):
    from specaudit.operators import triage

    df = spark.createDataFrame([("s1", 0.5, 0.3, 0.7), ("s2", -0.5, -0.7, -0.3), ("s3", 0.0, -0.2, 0.2)], "set_name string, excess_z double, lo double, hi double")
    got = {r["set_name"]: r for r in triage.significance(df).collect()}
    assert got["s1"]["beats_null_bh"] and not got["s2"]["beats_null_bh"] and got["s2"]["q"] < 1e-4 and not got["s3"]["beats_null_bh"]
    assert got["s1"]["p"] == pytest.approx(special.two_sided_p(0.5, 0.4 / (2 * 1.959963984540054)), rel=1e-12)


def test_legacy_contrast(spark):
    from specaudit.plans.audit import AuditConfig, legacy_null

    rng = np.random.default_rng(11)
    own = rng.normal(size=80)
    e = rng.normal(size=(80, 30))
    e[:, :6] += 2 * own[:, None]
    expr = spark.createDataFrame([(i, j, float(e[i, j])) for i in range(80) for j in range(30)], "sample long, gene int, value double")
    x = spark.createDataFrame([(i, [float(own[i]), float(rng.normal())]) for i in range(80)], "key long, x array<double>")
    folds = spark.createDataFrame([(i, i % 4) for i in range(80)], "key long, fold int")
    sets = spark.createDataFrame([("own", j) for j in range(6)], "set_name string, gene int")
    r = legacy_null(x, expr, sets, folds, AuditConfig(n_folds=4, n_null=8, ridge_alpha=1.0, matched=False)).first()
    assert r["beats_null"] and r["percentile"] > 90 and r["n_null"] == 8


def test_every_customer_has_a_barcode_of_its_own(spark, tmp_path):
    from specaudit.queries import cohorts

    keys = [1, 17, 9999, 10_000, 10_001, 15_000, 123_456, 1_223_055, 1_223_056, 1_223_081, 1_500_000, 46_000_000]
    spark.createDataFrame([(k, n, "m") for k, n in [(k, k % 25) for k in keys]], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["c_custkey"]: r for r in cohorts.barcode_annotate(spark, str(tmp_path)).collect()}
    whole = [k for k in keys if k % 17]
    assert sorted(got) == whole and len({r["patient_id"] for r in got.values()}) == len(whole)
    assert (got[9999]["patient_id"], got[10_000]["patient_id"], got[15_000]["tss"]) == ("TCGA-24-9999", "TCGA-00-A000", "00")
    assert sum(r["n_patients"] for r in cohorts.site_summary(spark, str(tmp_path)).collect()) == len(whole)


def test_sweep_and_estimable_take_every_row(spark, tmp_path):
    from specaudit.queries import cohorts

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    items = [(s, n, 0.01 * ((7 * s + n) % 11)) for s in range(6) for n in range(1, 8)] + [(6, 5, 0.04)]
    write("lineitem", items, "l_suppkey long, l_linenumber int, l_discount double")
    write("supplier", [(s,) for s in range(8)], "s_suppkey long")
    got = {r["split_seed"]: (r["isi"], r["source"]) for r in cohorts.sweep_merge(spark, str(tmp_path)).collect()}
    want = {s: (pytest.approx(np.mean([x for k, _, x in items if k == s]), abs=1e-6), "a") for s in range(7)}
    assert got == want | {s: (None, "missing") for s in (7, -1, -2, -3)}
    write("customer", [(k, k % 10, "ab"[k % 2], 1000.0 * k - 3000) for k in range(20)] + [(20, 3, "c", 1.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
    write("nation", [(k, 0) for k in range(10)], "n_nationkey int, n_regionkey int")
    write("region", [(0, "EUROPE")], "r_regionkey int, r_name string")
    got = {r["fold"]: (r["n"], r["n_estimable"]) for r in cohorts.combat_estimable(spark, str(tmp_path)).collect()}
    assert got == {0: (4, 4), 1: (4, 4), 2: (4, 4), 3: (5, 4), 4: (4, 4)}
