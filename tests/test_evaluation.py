"""Running sums, quantiles, calibration and model tools against numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelrisk.operators import calibrate, isotonic, metrics, ml, ordered, registry, splits
from panelrisk.sources.scratch import scratch_path


def newton(x, y, rounds=60):
    """Coefficients of a logistic fit; x with a column of ones first."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return w


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(3)
    pd = rng.beta(1, 6, 1500).round(7)
    y = (rng.random(1500) < 1 / (1 + np.exp(-(0.4 + 0.7 * np.log(pd / (1 - pd)))))).astype(int)
    return pd, y


@pytest.fixture(scope="module")
def frame(spark, scores):
    return spark.createDataFrame([(k, f"g{k % 3}", int(b), float(a)) for k, (a, b) in enumerate(zip(*scores, strict=True))], "key int, g string, label int, pd double").cache()


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending):
    rng = np.random.default_rng(1)
    rows = [("a" if k % 5 else None, float(v), int(rng.integers(0, 9))) for k, v in enumerate(rng.permutation(700))]
    got = ordered.running(spark.createDataFrame(rows, "g string, v double, c int"), "v", ["c"], "g", descending=descending).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [c for g, v, c in rows if g == r["g"] and (v >= r["v"] if descending else v <= r["v"])]
        assert (r["cum_c"], r["all_c"]) == (sum(own), sum(c for g, _, c in rows if g == r["g"]))


def test_quantiles_and_empty_table(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=333).round(1), "b": np.array([5.0]), "c": 1000 * rng.random(50)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)], "g string, v double")
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["g"]: r["quantiles"] for r in ordered.quantiles(df, "v", shares, "g").collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        assert np.allclose(got[g], np.quantile(vs, shares))
    assert ordered.quantiles(df.where("g = 'x'"), "v", shares, "g").count() == 0


def test_no_exchange_brings_rows_to_one_partition(frame):
    plan = ordered.running(frame.select("pd").distinct().withColumn("c", F.lit(1)), "pd", ["c"])._jdf.queryExecution().executedPlan().toString()
    single = [part for part in plan.split("SinglePartition")[1:]]
    assert all("partial_percentile_approx" in part[:1500] or "partial_sum" in part[:1500] or "HashAggregate" in part[:1500] or "ObjectHashAggregate" in part[:1500] for part in single)


def test_deciles_from_either_end(frame):
    up, down = ({r["decile"]: r for r in metrics.deciles(frame, 10, top).collect()} for top in (False, True))
    assert up[1]["n"] == down[10]["n"] and up[10]["mean_pd"] == down[1]["mean_pd"] and down[1]["cum_event_share"] > up[1]["cum_event_share"]


@pytest.mark.parametrize("method", ["platt", "beta"])
def test_calibration_is_the_logistic_fit(frame, scores, method):
    pd, y = scores
    p = np.clip(pd, 1e-6, 1 - 1e-6)
    x = np.column_stack([np.ones_like(p), np.log(p / (1 - p))] if method == "platt" else [np.ones_like(p), np.log(p), np.log(1 - p)])
    want = 1 / (1 + np.exp(-x @ newton(x, y)))
    got = calibrate.logistic_calibration(frame, frame, method).orderBy("key").toPandas()["calibrated"].to_numpy()
    assert np.abs(got - want).max() < 1e-9
    row = calibrate.metadata(frame, method).first()
    assert row["events"] == y.sum() and abs(row["mean_calibrated"] - y.mean()) < 1e-9 and row["log_loss_calibrated"] <= row["log_loss_raw"] and abs(row["parameters"]["slope_0"] - newton(x, y)[1]) < 1e-6


def test_isotonic_is_monotone_and_unbiased(frame):
    out = calibrate.isotonic_calibration(frame, frame).orderBy("pd").toPandas()
    assert (np.diff(out["calibrated"]) >= -1e-12).all() and abs(out["calibrated"].mean() - out["label"].mean()) < 1e-6


@pytest.mark.parametrize("partitions", [1, 7])
def test_isotonic_is_the_min_max_formula(spark, partitions):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(260), 2)
    y = (rng.random(260) < 0.2 + 0.5 * p).astype(int)
    fit = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "pd double, label int").repartition(partitions)
    xs = np.unique(p)
    n, s = np.array([(p == x).sum() for x in xs]), np.array([y[p == x].sum() for x in xs])
    mean = lambda a, b: s[a : b + 1].sum() / n[a : b + 1].sum()
    want = np.array([max(min(mean(a, b) for b in range(k, len(xs))) for a in range(k + 1)) for k in range(len(xs))])
    new = np.concatenate([xs, rng.random(40), [-1.0, 0.0, 1.0, 2.0]])
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(new)] + [(-1, None)], "key int, pd double").repartition(5)
    got = {r["key"]: r["calibrated"] for r in isotonic.isotonic(fit, df).collect()}
    assert got.pop(-1) is None
    assert np.allclose([got[k] for k in range(len(new))], np.interp(new, xs, want))
    own = isotonic.blocks(fit).orderBy("lo").collect()
    assert len(own) < len(xs) / 2 and all(a["hi"] < b["lo"] and a["value"] < b["value"] for a, b in zip(own, own[1:], strict=False))
    assert isotonic.isotonic(fit.limit(0), df).where("calibrated IS NOT NULL").count() == 0


@pytest.mark.parametrize("partitions", [1, 4])
def test_interpolation_reads_each_range_once(spark, partitions):
    """No frame ends in UNBOUNDED FOLLOWING, which reads the rest of a range for each row: 120,000 rows of one range took minutes."""
    at = np.arange(0, 60_000, 7)
    points = spark.createDataFrame([(float(x) + 0.25, float(x % 91)) for x in at], "x double, y double")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = isotonic.interpolated(spark.range(120_000).select((F.col("id") / 2).alias("x")), points)
        assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
        got = out.where("x = floor(x * 2) / 2").toPandas()  # points are rows too
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(got) == 120_000
    assert np.allclose(got["y"], np.interp(got["x"], at + 0.25, at % 91))


def test_medians_and_knots_are_exact(spark):
    """Of 60,000 values in any order, the middle one itself, where an approximate one is off by places; null and NaN do not count, nor do bounds that miss."""
    n = 60_000
    mixed = (F.col("id") * 7919 % n).cast("double")
    df = spark.range(n).select((mixed * mixed).alias("a"), F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, F.col("id").cast("double")).alias("b"), (F.col("id") % 5).cast("int").alias("c"), F.lit(None).cast("double").alias("d"))
    pick = lambda v, q: float(np.sort(v)[max(1, int(np.ceil(round(q * len(v), 6)))) - 1])
    shares = [0.0, 0.2, 0.5, 0.777, 1.0]
    want = {"a": [pick(np.arange(n) ** 2.0, q) for q in shares], "b": [pick(np.arange(1, n, 3.0), q) for q in shares], "c": [pick(np.arange(n) % 5, q) for q in shares], "d": []}
    assert ml.exact_quantiles(df, list("abcd"), shares) == want
    assert ml.exact_quantiles(df.repartition(7), list("abcd"), shares, near=-1e-3) == want  # bounds in the wrong order hold nothing
    model = ml.Medians(inputCols=["a", "c"], outputCols=["x", "y"]).fit(df)
    row = model.transform(spark.createDataFrame([(None, None)], "a double, c int")).select("x", "y")
    assert row.dtypes == [("x", "double"), ("y", "int")] and tuple(row.first()) == (want["a"][2], 2)
    with pytest.raises(ValueError):
        ml.Medians(inputCols=["d"], outputCols=["x"]).fit(df)


def test_interactions_keep_training_means(spark, tmp_path):
    from panelrisk.operators.interactions import Interactions, InteractionsModel

    rows = [(float(k), float(k * k % 7), k % 2) for k in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, g int").withColumn("v", array_to_vector(F.array("a", F.lit(1.0)))).withColumn("hot", array_to_vector(F.array(F.col("g").cast("double"), 1.0 - F.col("g"))))
    model = Interactions(pairs=[["a", "b"], ["v", "b"], ["v", "hot"]], outputCols=["ab", "vb", "vh"], plain=["hot"]).fit(df)
    model.write().overwrite().save(str(tmp_path / "i"))
    ma, mb = np.mean([r[0] for r in rows]), np.mean([r[1] for r in rows])
    new = df.limit(3).withColumn("a", F.col("a") + 100)
    for m in (model, InteractionsModel.load(str(tmp_path / "i"))):
        for r in m.transform(new).collect():
            assert np.allclose(r["ab"], [(r["a"] - ma) * (r["b"] - mb)]) and np.allclose(r["vb"], [(r["v"][0] - ma) * (r["b"] - mb), 0.0])
            assert np.allclose(r["vh"], [(r["v"][0] - ma) * r["g"], (r["v"][0] - ma) * (1 - r["g"]), 0, 0])
    with pytest.raises(ValueError, match="two categories"):
        ml.gam_pipeline(["a"], ["c", "d"], pairs=[("c", "d")])


def test_gam_with_interactions_scores_alike_after_saving(spark, tmp_path):
    df = model_rows(spark)
    pipeline = ml.gam_pipeline(["credit_score", "dpd"], ["occupancy"], pairs=[("credit_score", "dpd"), ("dpd", "occupancy")], linear=["dpd"])
    model = ml.train(pipeline, df)
    names = ml.raw_names(model, df)
    assert set(names) == {"credit_score", "dpd", "occupancy", "credit_score x dpd", "dpd x occupancy"} and len(names) == model.stages[-1].numFeatures
    registry.save_version(model, str(tmp_path / "models"), "one")
    again, _ = registry.load_version(spark, str(tmp_path / "models"))
    a, b = ({r["key"]: r["pd"] for r in ml.score(m, df, ml.horizon_name(12)).withColumnRenamed("pd_12m", "pd").collect()} for m in (model, again))
    assert a == b


def test_versions_without_manifest_are_not_there(spark, tmp_path):
    df, root = model_rows(spark), str(tmp_path / "models")
    assert registry.versions(spark, root).count() == 0
    with pytest.raises(ValueError, match="no complete version"):
        registry.load_version(spark, root)
    model = ml.train(ml.linear_pipeline(["credit_score"], ["occupancy"]), df)
    model.write().overwrite().save(f"{root}/cut/model")  # interrupted before the manifest
    with pytest.raises(ValueError, match="no complete version cut"):
        registry.load_version(spark, root, "cut")
    registry.save_version(model, root, "1", {"train": registry.population(df.withColumn("vintage", F.col("key") % 3))}, {"ridge": 0.01})
    registry.save_version(model, root, "cut", {}, {})  # what was cut off can be written again
    with pytest.raises(ValueError, match="there already"):
        registry.save_version(model, root, "1")
    _, found = registry.load_version(spark, root, "1", df.columns)
    assert found["metadata"]["train"] == {"rows": 400, "events": df.where("label = 1").count(), "first_period": 0, "last_period": 2}
    assert found["config"] == {"ridge": 0.01} and found["numeric"] == ["credit_score"] and found["algorithm"] == "LogisticRegressionModel"
    assert {r["version"] for r in registry.versions(spark, root).collect()} == {"1", "cut"}
    with pytest.raises(ValueError, match="columns missing"):
        registry.load_version(spark, root, "1", ["key"])


def test_boosting_stops_early_and_is_checkpointed(spark):
    """Labels without a signal on the validation rows: boosting ends long before its last round; its lineage is cut on the way."""
    rows = [(k, float((k * 7919) % 11 < 4), float(k % 13), float((k * 31) % 17), "ab"[k % 2], k % 4 == 0) for k in range(600)]
    df = spark.createDataFrame(rows, "key int, label double, x double, z double, c string, later boolean")
    model = ml.train(ml.boosted_pipeline(["x", "z"], ["c"], validation="later", rounds=60, depth=3, tolerance=0.02, every=2), df)
    assert 1 <= len(model.stages[-1].trees) < 60
    assert spark.sparkContext.getCheckpointDir()
    full = ml.train(ml.boosted_pipeline(["x", "z"], ["c"], rounds=12, depth=2, every=3), df)
    assert len(full.stages[-1].trees) == 12
    again = ml.train(ml.boosted_pipeline(["x", "z"], ["c"], rounds=12, depth=2, every=100), df)  # checkpoints change nothing
    a, b = ({r["key"]: r["pd"] for r in ml.score(m, df).collect()} for m in (full, again))
    assert a == b
    # boosting adds trees to the log odds: the score is that of their weighted sum
    t = full.stages[-1]
    x = full.transform(df).select("key", "features").collect()
    for r in x[:40]:
        margin = sum(w * tree.predict(r["features"]) for w, tree in zip(t.treeWeights, t.trees, strict=True))
        assert abs(a[r["key"]] - 1 / (1 + np.exp(-2 * margin))) < 1e-9


def test_methods_in_long_form(frame):
    long = calibrate.methods(frame, frame)
    assert {r["method"]: r["count"] for r in long.groupBy("method").count().collect()} == dict.fromkeys(calibrate.METHODS, 1500)


def test_slopes_by_group(spark, frame, scores):
    pd, y = scores
    got = {r["g"]: r for r in calibrate.slopes(frame.unionByName(spark.createDataFrame([(9, "one class", 1, 0.5)], frame.schema)), "g").collect()}
    for g in range(3):
        x = np.column_stack([np.ones(500), np.log(pd[g::3] / (1 - pd[g::3]))])
        assert np.allclose((got[f"g{g}"]["intercept"], got[f"g{g}"]["slope"]), newton(x, y[g::3]), atol=1e-6)
    assert got["one class"]["slope"] is None


def model_rows(spark):
    rows = [(k, float((k % 3 == 0) ^ (k % 11 == 0)), float(k % 3) + 0.1 * (k % 7), float(k % 5), ["a", "b"][k % 2]) for k in range(400)]
    return spark.createDataFrame(rows, "key int, label double, credit_score double, dpd double, occupancy string")


def test_importance_contract_and_ablation(spark, tmp_path):
    df = model_rows(spark)
    ml.check_features(df, ["credit_score", "dpd"], ["occupancy"])
    with pytest.raises(ValueError, match="twice.*not in the table.*not a number"):
        ml.check_features(df, ["dpd", "dpd", "gone", "occupancy"], [])
    forest = ml.train(ml.forest_pipeline(["credit_score", "dpd"], ["occupancy"]), df)
    rows = ml.tree_importance(forest, df).orderBy("position").collect()
    assert rows[0]["feature"] == "credit_score" and abs(rows[-1]["cum_share"] - 1) < 1e-9 and {r["feature"] for r in rows} == {"credit_score", "dpd", "occupancy"}
    lost = {r["feature"]: r for r in ml.permutation_importance(forest, df, ["key"], ["credit_score", "occupancy"], repeats=3).collect()}
    assert lost["credit_score"]["auc_loss"] > 0.1 > abs(lost["occupancy"]["auc_loss"]) and lost["credit_score"]["auc_loss_std"] >= 0
    out = {r["left_out"]: r["auc_change"] for r in ml.ablation(ml.forest_pipeline, ["credit_score", "dpd"], ["occupancy"], {"score": ["credit_score"]}, df, df).collect()}
    assert out["nothing"] == 0 and out["score"] < -0.1
    ml.save_model(forest, str(tmp_path / "m"))
    model, columns = ml.load_model(str(tmp_path / "m"), df)
    assert columns == ["credit_score", "dpd", "occupancy"] and ml.score(model, df).count() == 400
    with pytest.raises(ValueError, match="missing"):
        ml.load_model(str(tmp_path / "m"), df.drop("dpd"))


def test_permuted_values_are_the_same_with_nulls(spark):
    df = model_rows(spark).withColumn("dpd", F.expr("IF(key % 4 = 0, NULL, dpd)"))
    of = lambda rows, c: sorted(str(r[c]) for r in rows)
    want = df.collect()
    assert of(ml.permuted(df, ["key"], "dpd").collect(), "dpd") == of(want, "dpd")
    rows = ml.all_permuted(df, ["key"], ["dpd", "occupancy"], 2).collect()
    assert len(rows) == 4 * len(want)
    for k, c, other in ((0, "dpd", "occupancy"), (1, "occupancy", "dpd")):
        for d in range(2):
            own = [r for r in rows if (r["_column"], r["_draw"]) == (k, d)]
            assert of(own, c) == of(want, c) and {r["key"]: r[other] for r in own} == {r["key"]: r[other] for r in want} and {r["key"]: r[c] for r in own} != {r["key"]: r[c] for r in want}


def test_contributions_are_exact(spark):
    df = model_rows(spark)
    model = ml.train(ml.linear_pipeline(["credit_score", "dpd"], ["occupancy"]), df)
    x = np.array([r["features"].toArray() for r in model.transform(df).orderBy("key").select("features").collect()])
    parts = model.stages[-1].coefficients.toArray() * (x - x.mean(axis=0))
    want = {"credit_score": parts[:, 0], "dpd": parts[:, 1], "occupancy": parts[:, 2:].sum(axis=1)}
    rows = ml.model_contributions(model, df, ["key"]).collect()
    assert len(rows) == 1200
    for r in rows:
        assert np.isclose(r["contribution"], want[r["feature"]][r["key"]])
    # they add up to what the score of a row is above that of mean inputs
    total = {r["key"]: r["s"] for r in ml.model_contributions(model, df, ["key"]).groupBy("key").agg(F.sum("contribution").alias("s")).collect()}
    p = {r["key"]: r["pd"] for r in ml.score(model, df).collect()}
    base = model.stages[-1].intercept + model.stages[-1].coefficients.toArray() @ x.mean(axis=0)
    assert all(np.isclose(np.log(p[k] / (1 - p[k])), base + total[k]) for k in p)
    got = {r["feature"]: r for r in ml.contributions(model, df).collect()}
    for f, v in want.items():
        assert np.isclose(got[f]["mean_abs"], np.abs(v).mean()) and abs(got[f]["mean"]) < 1e-9
    assert abs(sum(r["share"] for r in got.values()) - 1) < 1e-9


def test_split_dispatch_and_scratch(spark):
    df = spark.createDataFrame([(k, 1990 + k % 4, k % 2) for k in range(40)], "loan_id int, vintage int, y int")
    with pytest.raises(ValueError, match="no split"):
        splits.dispatch(df, "other")
    years = {"train": [1990, 1991], "test": [1992], "oot": [1993, 1999]}
    rows = {r["split"]: r for r in splits.with_years(splits.dispatch(df, "yearly", **years), "y", "loan_id", years).collect()}
    assert rows["oot"]["vintages_without_rows"] == 1 and rows["train"]["first_vintage"] == 1990
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_training_job_rejects_one_class_and_saves_nothing(spark, tmp_path):
    import os

    from panelrisk.plans import jobs

    source, target = str(tmp_path / "input"), str(tmp_path / "model")
    spark.createDataFrame([(2000, 0, 1.0), (2001, 0, 2.0), (2002, 1, 3.0)], "vintage int, future_90dpd int, x double").write.parquet(source)
    years = {"train": [2000], "test": [2001], "oot": [2002]}
    with pytest.raises(ValueError, match="1 classes"):
        jobs.train(spark, source, target, ml.linear_pipeline(["x"], []), years)
    assert not os.path.exists(target)


def test_products_with_a_group_are_sparse(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import SparseVector

    df = model_rows(spark)
    stages = ml.gam_pipeline(["credit_score", "dpd"], ["occupancy"], group="occupancy", group_scale=0.25, linear=["dpd"]).getStages()[:-1]
    model = Pipeline(stages=stages).fit(df)
    basis, hot = vector_to_array("credit_score_filled_basis"), vector_to_array("occupancy_hot")
    for r in model.transform(df).select("credit_score_by_occupancy_own", "dpd_by_occupancy_own", "dpd", basis.alias("b"), hot.alias("h")).collect():
        assert isinstance(r[0], SparseVector) and np.array_equal(r[0].toArray(), np.outer(r["b"], r["h"]).ravel() * 0.25)
        assert np.array_equal(r[1].toArray(), np.array(r["h"]) * r["dpd"] * 0.25)
    assert {"credit_score x occupancy", "dpd x occupancy"} <= set(ml.raw_names(model, df))
