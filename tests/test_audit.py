"""Planted truth: a set that the predictor can see beyond the common axis, and one that it cannot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specaudit.operators import axis as axes
from specaudit.operators import nulls, scoring, splits
from specaudit.plans.audit import AuditConfig, baselines, run_audit, run_variants


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n, g = 240, 120
    factors = rng.normal(size=(n, 6))
    load = rng.normal(size=(6, g)) * 0.6
    load[0] = rng.uniform(1.0, 1.4, g)
    own = rng.normal(size=(n, 2))
    expr = factors @ load + 0.5 * rng.normal(size=(n, g))
    expr[:, :12] += 1.5 * own[:, :1]
    expr[:, 40:52] += 1.5 * own[:, 1:]
    x = np.column_stack([factors[:, 0] + 0.3 * rng.normal(size=n), own[:, 0] + 0.3 * rng.normal(size=n), rng.normal(size=(n, 6))])
    names = [f"P{i:04d}" for i in range(n)]
    frame = spark.createDataFrame([(names[i], f"S{i % 12:02d}", "AB"[i % 2], float(rng.uniform()), x[i].tolist()) for i in range(n)], "patient_id string, tss string, cancer_type string, purity double, x array<double>")
    long = spark.createDataFrame([(names[i], j, float(expr[i, j])) for i in range(n) for j in range(g)], "sample string, gene int, value double")
    sets = spark.createDataFrame([("seen", j) for j in range(12)] + [("unseen", j) for j in range(40, 52)], "set_name string, gene int")
    surv = spark.createDataFrame([(names[i], float(rng.exponential(np.exp(-own[i, 0])) + 0.01), 1.0, "AB"[i % 2]) for i in range(n)], "sample string, time double, event double, type string")
    return frame, long, sets, surv


def test_audit_finds_what_the_predictor_sees(planted, tmp_path):
    frame, long, sets, surv = planted
    r = run_audit(frame, long, sets, AuditConfig(n_null=10, n_boot=60, min_patients=100, ridge_alpha=10.0, disattenuate=False, with_raw_null=True, with_combat=True), survival=surv)
    excess = {x["set_name"]: x for x in r.tables["immune_excess"].collect()}
    assert excess["seen"]["beats_null"] and excess["seen"]["excess_z"] > 0.5
    assert not excess["unseen"]["beats_null"]
    assert r.primary["lo"] < r.primary["value"] < r.primary["hi"] and r.primary["n"] == 2 and r.primary["n_rows"] == 240
    r.check_estimand()
    arm = {(x["set_name"], x["adjustment"]): x for x in r.tables["outcome_arm"].collect()}
    assert len(arm) == 4 and abs(arm["seen", "axis_residualised"]["observed"] - 0.5) > 0.15
    assert {"per_signature", "three_way", "rotation", "site_control"} <= set(r.tables)
    # the secondary contrast, the ladder and the raw null, from the predictions and the frame
    p = r.tables["predictions"].toPandas()
    error = (p["y_true"] - p["y_pred"]).abs().groupby([p["key"], p["target"], p["scheme"]]).first().unstack()
    lost = r.tables["secondary"].first()
    assert lost["value"] == pytest.approx((error["preserved_site"] - error["random_patient"]).mean()) and lost["lo"] <= lost["value"] <= lost["hi"] and lost["n"] == 240
    ladder = {x["signature"]: x for x in r.tables["decomposition"].collect()}
    f = frame.select("patient_id", "tss", "cancer_type", "purity").toPandas().set_index("patient_id")
    own = p[(p["target"] == "seen") & (p["scheme"] == "preserved_site")].set_index("key").join(f)
    y = own["y_true"].to_numpy()
    for name, columns in (("M1_purity", [own["purity"]]), ("M3_site", [own["purity"], *[own["tss"] == s for s in sorted(set(own["tss"]))]]), ("Image_only", [own["y_pred"]])):
        a = np.column_stack([np.ones(len(y)), *[c.to_numpy(float) for c in columns]])
        rest = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
        assert ladder["seen"][name] == pytest.approx(1 - rest @ rest / ((y - y.mean()) ** 2).sum(), abs=1e-8), name
    assert ladder["seen"]["incremental_image_r2"] > ladder["unseen"]["incremental_image_r2"] and ladder["seen"]["n_share"] == 240
    raw = {x["set_name"]: x for x in r.tables["raw_null"].collect()}
    assert set(raw) == {"seen", "unseen"} and raw["seen"]["n_null"] == 10
    assert any("can be estimated for 0 of 240" in n for n in r.notes) and {x["estimable"] for x in r.tables["site_control_combat"].collect()} == {1.0}
    assert len(r.fingerprint) == 64
    r.save(str(tmp_path))


def test_audit_makes_its_matrix_and_scores_once(planted, monkeypatch):
    """Each of some ten plans made the matrix anew, and the scores of all draws were made for the lines and again for residuals."""
    frame, long, sets, _ = planted
    seen, calls = long.sparkSession.sparkContext.accumulator(0), []
    plain = scoring.score_sets

    def count(v):
        seen.add(1)
        return v

    def scored(*args):
        out = plain(*args)
        calls.append(out)
        return out

    monkeypatch.setattr(scoring, "score_sets", scored)
    matrix = long.withColumn("value", F.udf(count, "double")("value"))
    r = run_audit(frame, matrix, sets, AuditConfig(n_null=6, n_boot=20, min_patients=100, ridge_alpha=10.0, purity_col=None, with_site_control=False))
    assert r.tables["immune_excess"].count() == 2 and r.primary["n_rows"] == 240
    assert seen.value == 240 * 120
    assert len(calls) == 2 and all(x.is_cached for x in calls)


def test_audit_refuses_repeated_patients(planted):
    frame, long, sets, _ = planted
    with pytest.raises(ValueError, match="repeated"):
        run_audit(frame.unionAll(frame.limit(1)), long, sets)


def brute_audit(x, expr, sets, draws, axis, types, folds, n_folds):
    """Excess of each set by plain NumPy: scores, residuals within types, reliabilities, penalties, refits, contrasts."""
    grid = np.logspace(-2, 5, 24)
    z = (expr - expr.mean(0)) / expr.std(0, ddof=1)
    score = lambda genes: z[:, genes].mean(1)

    def resid(v):
        out = np.full(len(v), np.nan)
        for t in set(types):
            at = types == t
            a = np.column_stack([np.ones(at.sum()), axis[at]])
            out[at] = v[at] - a @ np.linalg.lstsq(a, v[at], rcond=None)[0]
        return out

    item = np.array([resid(z[:, j]).var(ddof=1) for j in range(z.shape[1])])

    def reliability(r, genes):
        k = len(genes)
        return min(1.0, max(0.0, k / (k - 1) * (1 - item[genes].sum() / (k * k * r.var(ddof=1)))))

    def fit(a, y, penalty):
        u, s, vt = np.linalg.svd(a - a.mean(0), full_matrices=False)
        return vt.T @ ((s / (s**2 + penalty)) * (u.T @ (y - y.mean())))

    def scaled(train, *others):
        med = np.nanmedian(train, axis=0)
        filled = [np.where(np.isnan(v), med, v) for v in (train, *others)]
        m, s = filled[0].mean(0), filled[0].std(0)
        return [(v - m) / s for v in filled]

    def penalty_of(y, k):
        a = scaled(x[folds != k])[0]
        y = y[folds != k]
        u, s, _ = np.linalg.svd(a, full_matrices=False)
        errors = []
        for p in grid:
            hat = (u * (s**2 / (s**2 + p))) @ u.T + 1 / len(y)
            errors.append((((y - hat @ y) / (1 - np.diag(hat))) ** 2).mean())
        return grid[int(np.argmin(errors))]

    def predicted(y, penalties):
        p = np.zeros(len(y))
        for k in range(n_folds):
            a, b = scaled(x[folds != k], x[folds == k])
            p[folds == k] = y[folds != k].mean() + b @ fit(a, y[folds != k], penalties[k])
        return np.corrcoef(y, p)[0, 1]

    out = {}
    for name, genes in sets.items():
        own = resid(score(genes))
        penalties = [penalty_of(own, k) for k in range(n_folds)]
        corrected = lambda r, rel: np.arctanh(np.clip(r / np.sqrt(rel), -0.999999, 0.999999)) if rel > 0.01 and abs(r / np.sqrt(rel)) < 1 else np.nan
        seen = corrected(predicted(own, penalties), reliability(own, genes))
        null = [corrected(predicted(v, penalties), reliability(v, g)) for g in draws[name] for v in [resid(score(g))]]
        out[name] = seen - np.nanmean(null) if np.isfinite(null).sum() >= 5 else None
    return out


def test_primary_estimate_equals_plain_numpy(planted, spark):
    """All draws make the value, the cap on draws only the interval; features with gaps are filled before penalties are chosen."""
    frame, long, sets, _ = planted
    holes = F.transform("x", lambda v, i: F.when((F.substring("patient_id", 2, 4).cast("int") * 7 + i * 3) % 29 != 0, v))
    frame = frame.withColumn("x", holes)
    config = AuditConfig(n_null=40, n_boot=40, min_patients=100, with_site_control=False, max_null_for_boot=20, n_folds=3)
    r = run_audit(frame, long, sets, config)
    rows = frame.orderBy("patient_id").collect()
    place = {p["patient_id"]: i for i, p in enumerate(rows)}
    x = np.array([[np.nan if v is None else v for v in p["x"]] for p in rows])
    expr = np.zeros((len(rows), 120))
    for e in long.collect():
        expr[place[e["sample"]], e["gene"]] = e["value"]
    types = np.array([p["cancer_type"] for p in rows])
    folds = np.zeros(len(rows), int)
    for f in splits.preserved_site_split(frame, "tss", "patient_id", 3, seed=0).folds.collect():
        folds[place[f["key"]]] = f["fold"]
    axis = np.zeros(len(rows))
    for e in axes.global_axis_pc1(long, frame.select(F.col("patient_id").alias("sample"), F.col("cancer_type").alias("group"))).collect():
        axis[place[e["sample"]]] = e["axis"]
    bins = nulls.level_bins(long.groupBy("gene").agg(F.avg("value").alias("level")))
    draws = {"seen": [[] for _ in range(40)], "unseen": [[] for _ in range(40)]}
    for d in nulls.random_sets(sets, bins, 40, 0).collect():
        draws[d["set_name"]][d["draw"]].append(d["gene"])
    want = brute_audit(x, expr, {"seen": list(range(12)), "unseen": list(range(40, 52))}, draws, axis, types, folds, 3)
    got = {e["set_name"]: e["excess_z"] for e in r.tables["immune_excess"].collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert r.primary["value"] == pytest.approx(np.mean(list(want.values())), abs=1e-6)
    assert r.primary["n"] == 2 and r.primary["n_rows"] == 240 and r.primary["n_draws"] == 40 and r.primary["lo"] < r.primary["hi"]
    r.check_estimand()
    assert "the interval uses 20 of 40 draws, the value all of them" in r.notes


def test_baselines_equal_fits(spark):
    rng = np.random.default_rng(3)
    n = 90
    g, u, fold = rng.integers(0, 5, n), rng.normal(size=n), np.arange(n) % 3
    y = np.column_stack([g + rng.normal(size=n), u + rng.normal(size=n)])
    df = spark.createDataFrame([(f"s{k}", int(g[i]), float(u[i]), int(fold[i]), float(y[i, k])) for i in range(n) for k in range(2)], "set_name string, g int, u double, fold int, score double")
    got = {r["set_name"]: r for r in baselines(df, groups={"g": "g"}, numbers={"u": "u"}).collect()}
    for k in range(2):
        by_group, by_line = np.zeros(n), np.zeros(n)
        for f in range(3):
            tr, te = fold != f, fold == f
            by_group[te] = [y[tr & (g == v), k].mean() if (tr & (g == v)).any() else y[tr, k].mean() for v in g[te]]
            by_line[te] = np.polyval(np.polyfit(u[tr], y[tr, k], 1), u[te])
        assert got[f"s{k}"]["r_g"] == pytest.approx(np.corrcoef(y[:, k], by_group)[0, 1])
        assert got[f"s{k}"]["r_u"] == pytest.approx(np.corrcoef(y[:, k], by_line)[0, 1])


def test_variants_change_what_they_name(planted):
    frame, long, sets, _ = planted
    base = AuditConfig(n_null=6, n_boot=25, min_patients=100, ridge_alpha=10.0, disattenuate=False, with_site_control=False)
    r = run_variants(frame, long, sets, base, {"same": {}, "unmatched": {"matched": False}})
    assert set(r) == {"same", "unmatched"} and r["same"].config == base and not r["unmatched"].config.matched
    assert r["same"].primary["value"] != r["unmatched"].primary["value"] and "2 sets" in r["same"].headline()
