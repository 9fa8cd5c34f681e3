"""Metrics, drift, splines and calibration: known values and properties."""

import math

import pytest
from pyspark.sql import functions as F

from panelrisk.operators import calibrate, drift, metrics, ml


def frame(spark, y, p):
    return spark.createDataFrame([(k, int(a), float(b)) for k, (a, b) in enumerate(zip(y, p, strict=True))], "key int, label int, pd double")


def test_known_values(spark):
    df = frame(spark, [0, 0, 1, 1], [0.1, 0.3, 0.7, 0.9])
    assert tuple(metrics.rank_metrics(df).first()) == (1.0, 1.0, 1.0)
    r = metrics.confusion(df, 0.5).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) == (2, 0, 0, 2, 1.0)


def test_ties_are_one_group(spark):
    r = metrics.rank_metrics(frame(spark, [0, 1, 0, 1, 1, 0], [0.5] * 4 + [0.9, 0.1])).first()
    assert math.isclose(r["roc_auc"], (3 + 2 * (1 + 2 * 0.5)) / 9) and math.isclose(r["ks"], max(1 / 3, 1 - 2 / 3))
    assert tuple(metrics.rank_metrics(frame(spark, [0, 1], [0.5, 0.5])).first())[0] == 0.5


def test_one_class_has_no_rank_metrics(spark):
    assert metrics.rank_metrics(frame(spark, [0, 0], [0.1, 0.2])).first()["roc_auc"] is None
    with pytest.raises(ValueError):
        ml.train(ml.linear_pipeline(["pd"], []), frame(spark, [0, 0], [0.1, 0.2]))


def test_auc_is_invariant_under_monotone_maps(spark):
    df = frame(spark, [(k * 7) % 3 == 0 for k in range(60)], [((k * 13) % 50) / 50 for k in range(60)])
    a, b = (metrics.rank_metrics(d).first() for d in (df, df.withColumn("pd", F.col("pd") ** 3)))
    assert all(math.isclose(x, y) for x, y in zip(a, b, strict=True))


def test_bins_and_extremes(spark):
    df = frame(spark, [0, 0, 1, 1], [0.0, 0.5, 0.5001, 1.0])
    assert sorted((r["bin"], r["n"]) for r in metrics.calibration_table(df, [0.0, 0.5, 1.0]).collect()) == [(1, 2), (2, 2)]
    assert math.isfinite(metrics.point_metrics(df).first()["log_loss"])


def test_psi(spark):
    same = spark.createDataFrame([(b, float(k), str(k % 3)) for b in (0, 1) for k in range(50)], "b int, x double, c string")
    assert abs(drift.numeric_psi(same, "b", ["x"]).first()["psi"]) < 1e-12 and abs(drift.categorical_psi(same, "b", ["c"]).first()["psi"]) < 1e-12
    gone = same.withColumn("c", F.when(F.col("b") == 0, None).otherwise(F.col("c")))
    assert drift.categorical_psi(gone, "b", ["c"]).first()["psi"] > 5
    assert drift.numeric_psi(same.withColumn("x", F.lit(1.0)), "b", ["x"]).first()["psi"] is None


def test_spline_bases_add_up_to_one(spark):
    xs = spark.createDataFrame([(float(x),) for x in (-5, 0, 1, 2, 2.5, 3, 7, 10, 99)] + [(None,)], "x double")
    rows = xs.select("x", ml.basis(F.col("x"), [0.0, 2.0, 3.0, 7.0, 10.0]).alias("b")).collect()
    for r in rows:
        assert r["b"] is None if r["x"] is None else len(r["b"]) == 7 and math.isclose(sum(r["b"]), 1.0) and min(r["b"]) >= 0


def test_pipelines_fit_save_and_score_alike(spark, tmp_path):
    rows = [(k, float(k % 2 if k % 5 else 1 - k % 2), float(k % 17) + 5 * (k % 2), ["a", "b", None][k % 3], f"g{k % 4}") for k in range(240)]
    df = spark.createDataFrame(rows, "key int, label double, x double, c string, g string")
    for pipeline in (ml.linear_pipeline(["x"], ["c"]), ml.gam_pipeline(["x"], ["c", "g"], pairs=[("x", "c")], group="g")):
        model = ml.train(pipeline, df)
        model.write().overwrite().save(str(tmp_path / "m"))
        again = ml.PipelineModel.load(str(tmp_path / "m"))
        a, b = ({r["key"]: r["pd"] for r in ml.score(m, df.withColumn("c", F.lit("unseen"))).collect()} for m in (model, again))
        assert a == b and all(0 < p < 1 for p in a.values())


def test_group_scale_shrinks(spark):
    rows = [(k, float((k % 4 == 0) ^ (k % 11 == 0)), float(k % 7), f"g{k % 4}") for k in range(400)]
    df = spark.createDataFrame(rows, "key int, label double, x double, g string")
    spread = []
    for scale in (1.0, 0.05):
        p = ml.score(ml.train(ml.gam_pipeline(["x"], ["g"], group="g", group_scale=scale), df), df)
        spread.append(p.groupBy("g").agg(F.avg("pd").alias("m")).agg(F.max("m") - F.min("m")).first()[0])
    assert spread[1] < 0.5 * spread[0]


def test_calibration_does_not_worsen_the_fit(spark):
    df = frame(spark, [(k * 7) % 10 < 2 for k in range(300)], [0.3 + 0.6 * ((k * 13) % 50) / 50 for k in range(300)])
    raw = metrics.point_metrics(df).first()["log_loss"]
    for out in (calibrate.logistic_calibration(df, df, "platt"), calibrate.logistic_calibration(df, df, "beta"), calibrate.isotonic_calibration(df, df), calibrate.intercept_calibration(df, df)):
        assert metrics.point_metrics(out.withColumn("pd", F.col("calibrated"))).first()["log_loss"] <= raw + 1e-9
