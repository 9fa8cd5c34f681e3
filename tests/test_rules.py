"""Rules with scopes, the full quality report, and profiles, by value on small tables."""

import numpy as np
from pyspark.sql import functions as F

from panelrisk.operators import aggregates, drift, ml, quality, rules


def loans(spark):
    kind = "loan_id int, vintage int, harp_indicator string, original_ltv int, original_cltv int, period int, estimated_ltv int, upb_change double, current_actual_upb double, original_upb double"
    rows = [
        (1, 2000, None, 110, 120, 560, 80, 1.0, 11.0, 10.0),  # ltv above the narrow domain
        (2, 2000, " y", 110, 90, 560, 999, 1.0, 11.0, 10.0),  # allowed for relief loans; cltv below ltv
        (3, 2018, None, 110, 999, 570, 80, 1.5, 11.0, 10.0),  # wide from 2018 on; change is off
        (4, 2000, "N", None, None, 560, None, None, 11.0, 10.0),
        (5, 2018, None, 0, 5, 566, 70, 1.0, 11.0, 10.0),  # below any domain
    ]
    return spark.createDataFrame(rows, kind)


def by_check(df):
    return {r["check"]: (r["in_scope"], r["bad_rows"], r["status"]) for r in df.collect()}


def test_rules_by_scope(spark):
    got = by_check(rules.checked(loans(spark), rules.loan_domains()))
    assert got["ltv_narrow"] == (1, 1, "FAIL") and got["ltv_relief"] == (1, 0, "PASS") and got["ltv_wide"] == (2, 1, "FAIL")
    assert got["cltv_not_below_ltv"] == (3, 1, "FAIL") and got["original_upb_not_negative"] == (5, 0, "PASS")
    assert got["original_dti"] == (0, 0, "SKIPPED") and got["max_dpd_to_date_not_negative"][2] == "SKIPPED"
    ids = by_check(rules.checked(loans(spark), rules.loan_identities()))
    assert ids["upb_change"] == (4, 1, "FAIL") and ids["term"] == (0, 0, "SKIPPED")


def test_availability_and_where_rows_break_rules(spark):
    own = [rules.available_from("eltv", "estimated_ltv", 567, 999), rules.available_from("late", "estimated_ltv", 600, 999, severity="warning")]
    got = by_check(rules.checked(loans(spark), own))
    assert got == {"eltv": (4, 2, "FAIL"), "late": (5, 3, "REVIEW")}
    where = {(r["check"], r["vintage"]): r["bad_rows"] for r in rules.broken(loans(spark), own, "vintage").collect()}
    assert where == {("eltv", 2000): 1, ("eltv", 2018): 1, ("late", 2000): 1, ("late", 2018): 2}
    assert rules.broken(loans(spark).limit(0), own, "vintage").count() == 0
    assert {r["status"] for r in rules.checked(loans(spark).limit(0), own).collect()} == {"PASS"}


def test_full_report_by_value(spark):
    orig = spark.createDataFrame([(1, 700, "CA"), (2, 9999, None), (3, 650, "TX"), (3, 650, "TX")], "loan_id int, credit_score int, state string")
    perf = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (9, 5)], "loan_id int, period int")
    rows = spark.createDataFrame([(1, 3, 1999, 1, 700.0, "CA", 0), (1, 6, 1999, 0, None, "CA", 1), (2, 3, 2000, 0, -5.0, None, 1)], "loan_id int, observation_age int, vintage int, y int, credit_score double, state string, credit_score_missing int")
    got = {k: [r.asDict() for r in t.collect()] for k, t in quality.report(orig, perf, rows, "y", ["credit_score"], ["state"], ["y", "future_loss"], {"credit_score": 9999}).items()}
    assert len(got) == 16
    assert {r["dataset"]: (r["rows"], r["columns"], r["loans"], r["missing_ids"], r["duplicate_rows"]) for r in got["summary"]} == {"origination": (4, 3, 3, 0, 1), "performance": (4, 2, 3, 0, 0), "input": (3, 7, 2, 0, 0)}
    assert [(r["feature"], r["bad_rows"], r["status"]) for r in got["indicators"]] == [("credit_score", 1, "FAIL")]
    assert {(r["feature"], r["label"]): (r["n"], r["median"], r["min"]) for r in got["target_features"]} == {("credit_score", 1): (1, 700.0, 700.0), ("credit_score", 0): (1, -5.0, -5.0)}
    assert [(r["n"], r["p50"], r["missing"]) for r in got["numeric"]] == [(2, 347.5, 1)]
    assert {(r["report"], r["item"], r["status"]) for r in got["issues"]} == {("grain", "origination", "FAIL"), ("sentinels", "credit_score", "REVIEW"), ("constant", "state", "FAIL"), ("leakage", "y", "FAIL"), ("indicators", "credit_score", "FAIL")}
    assert {r["stage"]: (r["loans"], r["missing"], r["extra"]) for r in got["reconciliation"]} == {"origination": (3, 0, 0), "performance": (3, 1, 1), "input": (2, 1, 0)}
    assert {r["dataset"]: (r["duplicate_rows"], r["status"]) for r in got["grain"]} == {"origination": (1, "FAIL"), "performance": (0, "PASS"), "input": (0, "PASS")}
    assert {r["vintage"]: (r["n"], r["event_rate"]) for r in got["target"]} == {1999: (2, 0.5), 2000: (1, 0.0)}
    assert [(r["negative"], r["zero"], r["min"], r["max"]) for r in got["numeric_values"]] == [(1, 0, -5.0, 700.0)]
    assert [(r["distinct_values"], r["missing"], r["top_value"], r["top_count"], r["top_share"]) for r in got["categories"]] == [(1, 1, "CA", 2, 1.0)]
    assert {r["feature"]: r["missing"] for r in got["missing"]} == {"credit_score": 1, "state": 1} and [r["bad_rows"] for r in got["sentinels"]] == [1]
    assert {r["feature"]: r["status"] for r in got["constant"]} == {"credit_score": "PASS", "state": "FAIL"}
    assert {r["feature"]: (r["present"], r["status"]) for r in got["leakage"]} == {"y": (True, "FAIL"), "future_loss": (False, "PASS")}
    assert {r["feature"]: r["filled"] for r in got["inventory"]}["credit_score"] == 2
    assert [(r["stage"], r["loans"]) for r in sorted(got["funnel"], key=lambda r: r["position"])] == [("origination", 3), ("performance", 3), ("input", 2)]
    long = quality.long_report({k: t for k, t in quality.report(orig, perf, rows, "y", ["credit_score"], ["state"], ["y"], {"credit_score": 9999}).items()})
    assert next(r["value"] for r in long.collect() if r["table"] == "funnel" and r["row"] == "input" and r["metric"] == "loans") == 2


def test_profiles_are_exact(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=501).round(1), np.exp(rng.normal(size=501))
    df = spark.createDataFrame([(float(a), float(b) if k % 10 else None, None, k % 3) for k, (a, b) in enumerate(zip(x, z, strict=True))], "x double, z double, none double, g int").repartition(3)
    z = z[[k % 10 != 0 for k in range(501)]]
    got = {r["feature"]: r for r in aggregates.numeric_profile(df, ["x", "z", "none"]).collect()}
    for c, v in (("x", x), ("z", z)):
        assert np.allclose([got[c][f"p{q:02d}"] for q in (1, 5, 50, 95, 99)], np.quantile(v, [0.01, 0.05, 0.5, 0.95, 0.99])) and got[c]["n"] == len(v)
        assert np.isclose(got[c]["mean"], v.mean()) and np.isclose(got[c]["std"], v.std(ddof=1))
    assert got["none"]["p50"] is None and got["none"]["missing"] == 501 and got["z"]["missing"] == 51
    by = {r["g"]: r for r in aggregates.profiled(aggregates.unpivoted(df, ["g"], ["x"]), ["feature", "g"], [F.max("value").alias("top")], {"median": 0.5}).collect()}
    assert all(np.isclose(by[g]["median"], np.median(x[g::3])) and by[g]["top"] == x[g::3].max() for g in range(3))


def test_mix_effect_in_per_cent(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "a", 1), (2, "a", 1), (2, "a", 0), (2, "b", 0)], "p int, s string, y int")
    r = {x["p"]: x for x in drift.standardized(df, "p", "s", "y", 1).collect()}
    assert np.isclose(r[2]["raw_rate"], 0.5) and np.isclose(r[2]["standard_rate"], 1 / 3) and np.isclose(r[2]["mix_effect_pct"], 100 * (0.5 - 1 / 3) / 0.5) and r[1]["mix_effect_pct"] == 0


def test_reasons_for_linear_columns(spark):
    df = spark.createDataFrame([(float(k), float(k % 2), None, float("inf") if k > 5 else 1.0 * k) for k in range(10)], "a double, b double, c double, d double")
    model = ml.Splines(inputCols=["a", "b", "c", "d"]).fit(df)
    reasons = model.getOrDefault(model.reasons)
    assert set(reasons) == {"b", "c", "d"} and "three" in reasons["b"] and "no training row" in reasons["c"] and "finite" in reasons["d"]
    out = model.transform(df.withColumns({"c": F.lit(0.0), "d": F.lit(1.0)})).first()
    assert len(out["b_basis"]) == 1 and len(out["a_basis"]) > 3
