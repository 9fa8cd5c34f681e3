"""Positions inside groups, edge searches, and the evaluation suite against row-level versions."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.operators import calibrate, metrics, ordered, suite
from panelrisk.plans import jobs

EDGES = [0.0, 0.05, 0.2, 0.5, 1.0]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    n = 1500
    p = np.where(rng.random(n) < 0.5, np.round(rng.random(n), 2), rng.random(n))
    p[:3] = [0.0, 1.0, 0.5]
    y = (rng.random(n) < 0.1 + 0.7 * p).astype(int)
    split = np.array(["train", "test", "oot"])[rng.integers(0, 3, n)]
    return p, y, split


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(k, str(s), int(b), float(a)) for k, (a, b, s) in enumerate(zip(*rows, strict=True))], "key int, split string, label int, pd double").cache()


def test_positions_follow_the_whole_key(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][k % 3], float(rng.integers(0, 6)), k) for k in range(900)]
    got = ordered.positions(spark.createDataFrame(rows, "g string, v double, k int"), [F.col("v").desc(), "k"], "g").collect()
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])
        assert [(r["v"], r["k"]) for r in own] == sorted(((v, k) for x, v, k in rows if x == g), key=lambda x: (-x[0], x[1]))
        assert [r["position"] for r in own] == list(range(1, len(own) + 1)) and {r["n_rows"] for r in own} == {len(own)}


def test_one_period_and_one_score_are_spread_over_tasks(spark):
    """All rows share a period and a score: ranges of the whole key still hold like numbers of them."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit(1).alias("period"), F.lit(0.25).alias("pd"), F.xxhash64("id").alias("loan_id"), F.lit(1.0).alias("current_actual_upb"))
        dealt = ordered._dealt(df, ["period", F.col("pd").desc(), F.col("current_actual_upb").desc(), "loan_id"])
        sizes = sorted(r["count"] for r in dealt.groupBy("_task").count().collect())
        assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
        ranked = jobs.intervene(df, 0.1)
        assert ranked.agg(F.min("intervention_rank"), F.max("intervention_rank"), F.count_distinct("intervention_rank")).first() == (1, 40_000, 40_000)
        ids = [r["loan_id"] for r in ranked.orderBy("intervention_rank").limit(50).collect()]
        assert ids == sorted(ids) and "Window" not in ranked.select("intervention_rank")._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_unflagged_rows_are_kept_without_rank(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, 7), (2, 0.05, 1.0, 7), (3, None, 1.0, 7), (4, 0.5, 3.0, 7), (5, 0.9, 3.0, 8)], "loan_id int, pd double, current_actual_upb double, period int")
    got = {r["loan_id"]: (r["intervention_flag"], r["intervention_band"], r["intervention_rank"]) for r in jobs.intervene(df, 0.1).collect()}
    assert got == {1: (1, "FLAG", 2), 2: (0, "NO_FLAG", None), 3: (0, "NO_FLAG", None), 4: (1, "FLAG", 1), 5: (1, "FLAG", 1)}


@pytest.mark.parametrize("edges", [[0.0], [1.0, 2.0], [0.0, 0.5, 0.5, 1.0, 7.5], list(range(31))])
def test_edges_are_searched(spark, edges):
    xs = [x + d for x in edges for d in (-0.25, 0.0, 0.25)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").withColumn("e", F.array(*[F.lit(float(e)) for e in edges]))
    for n in (len(edges), len(edges) + 4):
        got = df.select("x", ordered.edges_below(F.col("e"), F.col("x"), n).alias("k")).collect()
        assert all(r["k"] == sum(e < r["x"] for e in edges) for r in got)


@pytest.mark.parametrize(("lo", "hi", "step"), [(0.01, 0.3, 0.01), (0.01, 0.99, 0.01), (0.1, 1.0, 0.3), (0.003, 0.9, 0.0007)])
def test_thresholds_reached(spark, lo, hi, step):
    grid = metrics.thresholds(lo, hi, step)
    near = [x for t in grid for x in (t, np.nextafter(t, 0), np.nextafter(t, 1), t + step / 2)] + [0.0, 1.0]
    got = spark.createDataFrame([(float(x),) for x in near], "pd double").select("pd", metrics.reached(grid, step).alias("k")).collect()
    assert all(r["k"] == sum(t <= r["pd"] for t in grid) for r in got)
    with pytest.raises(ValueError):
        metrics.thresholds(0.0, 0.5, 0.1)


def test_plans_of_edges_have_no_lambda(frame):
    for df in (metrics.deciles(frame), metrics.threshold_grid(frame, 0.01, 0.9, 0.01)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "filter(edges" not in plan and "filter(array(0.01" not in plan


def close(a, b):
    return a == b or (a is None and b is None) or abs(a - b) < 1e-9


def test_suite_equals_metrics_over_rows(frame):
    got = suite.suite(frame, "split", edges=EDGES, grid=(0.01, 0.9, 0.05), threshold=0.3)
    for s in ("train", "test", "oot"):
        own = frame.where(F.col("split") == s).cache()
        table = metrics.calibration_table(own, EDGES)
        want = {
            "rank": metrics.rank_metrics(own), "point": metrics.point_metrics(own), "confusion": metrics.confusion(own, 0.3), "thresholds": metrics.threshold_grid(own, 0.01, 0.9, 0.05),
            "deciles": metrics.deciles(own), "calibration": table, "calibration_errors": metrics.calibration_errors(table), "curve": metrics.curve(own),
        }
        for name, w in want.items():
            key = suite.ROWS.get(name)
            a, b = ([r.asDict() for r in (d.orderBy(key) if key else d).collect()] for d in (got[name].where(F.col("split") == s).drop("split"), w))
            assert len(a) == len(b) and all(set(x) == set(y) and all(close(x[c], y[c]) for c in x) for x, y in zip(a, b, strict=True)), name
    alone = suite.suite(frame, edges=EDGES, grid=(0.01, 0.9, 0.05), threshold=0.3)
    assert alone["point"].count() == 1 and alone["deciles"].count() == 10


def test_top_shares_take_ties_in_proportion(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.5, 0), (0.5, 0), (0.1, 0), (0.1, 0), (0.1, 0), (0.1, 1), (0.1, 0)], "pd double, label int")
    r = suite.top_shares(suite.score_sums(df), [0.3]).first()
    assert (r["population"], r["captured"]) == (3, 1 + 2 * 0.25) and abs(r["mean_pd"] - (0.9 + 2 * 0.5) / 3) < 1e-12


def test_one_class_and_no_rows(spark, frame):
    one = suite.suite(frame.where("label = 0"), "split", edges=EDGES, grid=(0.1, 0.9, 0.1), threshold=0.3)
    assert all(r["roc_auc"] is None for r in one["rank"].collect()) and {r["recall"] for r in one["thresholds"].collect()} == {0.0}
    assert all(r["capture_rate"] is None and r["lift"] is None for r in one["top_shares"].collect())
    none = suite.suite(frame.where("label = 7"), "split", edges=EDGES, grid=(0.1, 0.9, 0.1), threshold=0.3)
    assert all(t.count() == 0 for t in none.values())


def test_evaluation_job_by_value(frame, rows, tmp_path):
    """The calibration is that of the test split, the threshold the best of it, and every split is measured with both."""
    p, y, split = rows
    tables = jobs.evaluate(frame.select("split", "label", "pd"), EDGES)
    cal = {r["key"]: r["calibrated"] for r in calibrate.logistic_calibration(frame.where("split = 'test'"), frame, "beta").collect()}
    q = np.array([cal[k] for k in range(len(p))])
    f1 = {}
    for k in range(1, 99):
        t, own = round(0.01 * k, 10), split == "test"
        tp, fp, fn = ((q >= t) & (y == 1) & own).sum(), ((q >= t) & (y == 0) & own).sum(), ((q < t) & (y == 1) & own).sum()
        f1[t] = 2 * tp / max(1, 2 * tp + fp + fn)
    best = tables["threshold"].first()
    assert best["f1"] == pytest.approx(max(f1.values())) and f1[best["threshold"]] == pytest.approx(max(f1.values()))
    for kind, score in (("raw", p), ("calibrated", q)):
        at = {r["split"]: r for r in tables[f"{kind}_confusion"].collect()}
        brier = {r["split"]: r["brier"] for r in tables[f"{kind}_point"].collect()}
        for s in ("train", "test", "oot"):
            own = split == s
            assert at[s]["tp"] == ((score >= best["threshold"]) & (y == 1) & own).sum() and at[s]["tn"] == ((score < best["threshold"]) & (y == 0) & own).sum()
            assert brier[s] == pytest.approx(((score - y)[own] ** 2).mean())
    jobs.save_tables(tables, str(tmp_path / "out"))
    saved = [json.loads(line) for f in os.listdir(tmp_path / "out" / "tables") if f.endswith(".json") for line in open(tmp_path / "out" / "tables" / f)]
    assert {r["table"] for r in saved} == {n for n in tables if not n.endswith("curve")}
    assert next(r["value"] for r in saved if r["table"] == "threshold" and r["metric"] == "f1") == pytest.approx(best["f1"])
    assert frame.sparkSession.read.parquet(str(tmp_path / "out" / "raw_curve")).count() == sum(len(set(p[split == s])) for s in ("train", "test", "oot"))


def test_issues_make_only_tables_with_a_status(spark, monkeypatch):
    """The issues of flagged tables are those of the whole report, and no quantiles are sorted for them."""
    from panelrisk.operators import quality
    from panelrisk.queries import storage

    frames = storage._frames(spark, "/root/testdata/sf0.001")
    whole = quality.report(*frames, "future_90dpd", **storage._REPORTED)
    want = sorted(map(tuple, whole["issues"].collect()))
    assert {n for n, t in whole.items() if "status" in t.columns} - {"issues"} == set(quality.flagged(*frames, **storage._REPORTED))
    monkeypatch.setattr(ordered, "_dealt", None)
    assert sorted(map(tuple, quality.issues(quality.flagged(*frames, **storage._REPORTED)).collect())) == want
