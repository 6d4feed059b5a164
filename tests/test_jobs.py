"""The jobs: two runs over growing input, reruns, odd rows, the command line."""

import json
import os
import re
import statistics
import subprocess
import sys

import numpy as np
import pytest

from jobs import set_audit, site_monitor

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "doc_id long, text string, lang string, source string, extra int"
FIRST = [(1, "Two words", "en", "a", 1), (2, "THREE 3 words\n\nand a line", "en", "b", 1), (3, None, "en", "a", 1), (None, "no id", "en", "a", 1), (4, " \t\n", None, None, 1)]
SECOND = [(5, "Zwei Wörter 22\x0b", "de", "a", 1), (1, "Two words", "en", "a", 1), (6, "x" * 50_000, "en", "b", 1), (7, "", "", "c", 1)]


def plain_report(rows):
    feature = {
        "n_nonspace": lambda t: len(re.sub(r"[ \t\n\x0b\f\r]", "", t)),
        "n_words": lambda t: len(re.findall(r"[^ \t\n\x0b\f\r]+", t)),
        "n_lines": lambda t: len(re.findall(r"[^\n]+", t)),
        "n_upper": lambda t: len(re.findall("[A-Z]", t)),
        "n_digits": lambda t: len(re.findall("[0-9]", t)),
    }
    out = {}
    for f, count in feature.items():
        cells = {}
        for i, t, kind, site, _ in rows:
            own = cells.setdefault((kind, site), [])
            own.append(count(t or "") if i is not None and feature["n_words"](t or "") >= 1 else None)
        for (kind, site), own in cells.items():
            kept = [v for v in own if v is not None]
            others = [v for (k, s), vs in cells.items() if k == kind and s != site for v in vs if v is not None]
            mean = statistics.mean(kept) if kept else None
            sd = statistics.stdev(kept) if len(kept) > 1 else None
            pooled = statistics.stdev(kept + others) if len(kept + others) > 1 else 0
            out[f, kind, site] = (len(own), len(kept), mean, sd, (mean - statistics.mean(others)) / pooled if kept and others and pooled else None)
    return out


def same(rows, expected):
    got = {(r["feature"], r["type"], r["site"]): (r["n_rows"], r["n"], r["mean"], r["sd"], r["gap"]) for r in rows}
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v), k


def test_site_monitor_takes_only_what_is_new(spark, tmp_path):
    where = [str(tmp_path / x) for x in ("docs", "out", "checkpoint")]

    def deliver(rows):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(where[0])

    def batches():
        return sorted((r["batch"], r["n"]) for r in spark.read.parquet(f"{where[1]}/moments").filter("feature = 'n_words'").groupBy("batch").agg({"n_rows": "sum"}).withColumnRenamed("sum(n_rows)", "n").collect())

    deliver(FIRST)
    same(site_monitor.run(spark, *where).collect(), plain_report(FIRST))
    before = batches()
    assert sum(n for _, n in before) == len(FIRST)
    same(site_monitor.run(spark, *where).collect(), plain_report(FIRST))  # nothing new
    assert batches() == before
    deliver(SECOND)
    grown = site_monitor.run(spark, *where, {"files_per_batch": 1}).collect()
    same(grown, plain_report(FIRST + SECOND))
    assert batches()[: len(before)] == before and sum(n for _, n in batches()) == len(FIRST + SECOND)
    # all at once, by a pattern: the same report
    whole = site_monitor.run(spark, f"{where[0]}/*.parquet", str(tmp_path / "out2"), str(tmp_path / "checkpoint2")).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, grown))
    # the output without its checkpoint would count all files twice
    with pytest.raises(ValueError, match="no checkpoint"):
        site_monitor.run(spark, where[0], where[1], str(tmp_path / "lost"))


def test_site_monitor_repeats_a_batch_that_failed(spark, tmp_path, monkeypatch):
    where = [str(tmp_path / x) for x in ("docs", "out", "checkpoint")]
    spark.createDataFrame(FIRST, SCHEMA).write.parquet(where[0])
    real = site_monitor.moments
    monkeypatch.setattr(site_monitor, "moments", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        site_monitor.run(spark, *where)
    monkeypatch.setattr(site_monitor, "moments", real)
    same(site_monitor.run(spark, *where).collect(), plain_report(FIRST))


def test_site_share_is_between_over_total(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 9) + (i % 3))), "en", f"s{i % 3}", 0) for i in range(300)]
    r = site_monitor.report(site_monitor.moments(spark.createDataFrame(rows, SCHEMA), site_monitor.CONFIG)).filter("feature = 'n_words'").collect()
    n = np.array([len(t.split()) for _, t, *_ in rows], float)
    between = sum(100 * (n[i::3].mean() - n.mean()) ** 2 for i in range(3))
    assert {round(x["site_share"], 9) for x in r} == {round(between / ((n - n.mean()) ** 2).sum(), 9)}
    assert site_monitor.report(site_monitor.moments(spark.createDataFrame([], SCHEMA), site_monitor.CONFIG)).count() == 0


@pytest.fixture(scope="module")
def matrix(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 80))
    x[:, 1:5] += x[:, [0]]  # the predictor, gene 0, sees set a
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    rows[3] = (3, [float("nan"), *rows[3][1][1:]], 1)
    rows[4] = (4, [rows[4][1][0], None, *rows[4][1][2:]], 0)
    rows += [(None, rows[5][1], 0), (900, rows[5][1], None), (901, None, 0)]
    path = str(tmp_path_factory.mktemp("matrix") / "m")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(path)
    return path


def test_set_audit_finds_the_planted_set_and_reruns_safely(spark, matrix, tmp_path):
    out, config = str(tmp_path / "out"), {"sets": {"a": [1, 2, 3, 4], "b|x": [9, 10, 11, 12]}, "n_draws": 8}
    first = sorted(map(repr, set_audit.run(spark, matrix, out, config).collect()))
    report = {r["set_name"]: r for r in spark.read.parquet(f"{out}/report").collect()}
    assert report["a"]["beats_null"] and not report["b|x"]["beats_null"] and report["a"]["r_residual"] > 0.4
    assert report["a"]["n"] == 159 and len(first) == 2 * 160
    assert sorted(map(repr, set_audit.run(spark, matrix, out, config).collect())) == first
    # one set alone leaves the other's partitions as they are
    set_audit.run(spark, matrix, out, config | {"n_draws": 5}, only=["a"])
    again = {r["set_name"]: r for r in spark.read.parquet(f"{out}/report").collect()}
    assert again["a"]["n_null"] == 5 and again["b|x"] == report["b|x"]
    with pytest.raises(ValueError, match="no sets"):
        set_audit.run(spark, matrix, out, config, only=["c"])


def test_jobs_run_from_the_command_line(spark, matrix, tmp_path):
    spark.createDataFrame(FIRST, SCHEMA).write.parquet(str(tmp_path / "docs"))
    (tmp_path / "sets.json").write_text(json.dumps({"sets": {"a": [1, 2, 3, 4]}, "n_draws": 5}))
    runs = {
        "site_monitor": ["--documents", tmp_path / "docs", "--output", tmp_path / "o1", "--checkpoint", tmp_path / "c1", "--config", f"{ROOT}/jobs/site_monitor.json"],
        "set_audit": ["--matrix", matrix, "--output", tmp_path / "o2", "--config", tmp_path / "sets.json", "--only", "a"],
    }
    for name, args in runs.items():
        done = subprocess.run([sys.executable, f"{ROOT}/jobs/{name}.py", *map(str, args)], capture_output=True, text=True, cwd=tmp_path, timeout=300)
        assert done.returncode == 0 and f"{name} " in done.stderr, done.stderr[-2000:]
    same(spark.read.parquet(str(tmp_path / "o1" / "report")).replace("", None).collect(), plain_report(FIRST))
    assert spark.read.parquet(str(tmp_path / "o2" / "scores")).count() == 160


def test_jobs_need_nothing_of_the_corpus_operators():
    for name in ("jobs/site_monitor.py", "jobs/set_audit.py", "specaudit/queries/jobs.py", "specaudit/sources/shared.py"):
        text = open(os.path.join(ROOT, name)).read()
        assert "llm" not in text and "corpus_pipeline" not in text
