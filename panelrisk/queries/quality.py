"""Queries on data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.operators import panel, pit, quality, rules, validate
from panelrisk.queries.base import clock, features, master, orig, perf, query, read

R6 = lambda df: df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
_REC = """SELECT '{s}' AS stage, count(DISTINCT b.k) AS loans, count(*) FILTER (WHERE b.k IS NULL) AS missing, count(*) FILTER (WHERE a.k IS NULL) AS extra, round(count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) / count(a.k), 6) AS retained
FROM (SELECT DISTINCT loan_id AS k FROM og) a FULL JOIN (SELECT DISTINCT loan_id AS k FROM {t}) b ON a.k = b.k"""


@query(" UNION ALL ".join(_REC.format(s=s, t=t) for s, t in (("origination", "og"), ("performance", "pf"), ("model_input", "mi"))))
def dq1_reconciliation(spark, sf_dir):
    return R6(quality.reconciliation({"origination": orig(spark, sf_dir), "performance": perf(spark, sf_dir), "model_input": features(spark, sf_dir)}, "loan_id"))


@query("""SELECT 'performance' AS dataset, (count(*) - count(DISTINCT (loan_id, period)))::BIGINT AS duplicate_rows, CASE WHEN count(*) = count(DISTINCT (loan_id, period)) THEN 'PASS' ELSE 'FAIL' END AS status FROM pf
UNION ALL SELECT 'orders', count(*) - count(DISTINCT o_custkey), CASE WHEN count(*) = count(DISTINCT o_custkey) THEN 'PASS' ELSE 'FAIL' END FROM orders""")
def dq2_grain(spark, sf_dir):
    return quality.grain(perf(spark, sf_dir), "performance", "loan_id", "period").unionByName(quality.grain(read(spark, sf_dir, "orders"), "orders", "o_custkey"))


@query("""WITH s AS (SELECT 0 AS position, 'performance' AS stage, count(DISTINCT loan_id) AS loans FROM pf UNION ALL SELECT 1, 'starts in time', count(*) FROM (SELECT loan_id FROM pf GROUP BY 1 HAVING min(age) <= 1)
UNION ALL SELECT 2, 'seen for a year', count(*) FROM (SELECT loan_id FROM pf GROUP BY 1 HAVING min(age) <= 1 AND max(age) >= 12) UNION ALL SELECT 3, 'model input', count(DISTINCT loan_id) FROM mi)
SELECT position::INT AS position, stage, loans, round(loans / lag(loans) OVER (ORDER BY position), 6) AS retention FROM s""")
def dq3_wn24_funnel(spark, sf_dir):
    ages = clock(spark, sf_dir).groupBy("loan_id").agg(F.min("calculated_loan_age").alias("a"), F.max("calculated_loan_age").alias("z"))
    return R6(quality.funnel([("performance", ages), ("starts in time", ages.where("a <= 1")), ("seen for a year", ages.where("a <= 1 AND z >= 12")), ("model input", features(spark, sf_dir))], "loan_id"))


_V = ["current_actual_upb", "estimated_ltv", "months_since_last_delinquency"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE isinf({c}::DOUBLE)) AS infinite, count(*) FILTER (WHERE {c} < 0) AS negative, count(*) FILTER (WHERE {c} = 0) AS zero, round(min({c})::DOUBLE, 2) AS min, round(max({c})::DOUBLE, 2) AS max FROM mi" for c in _V))
def dq4_values(spark, sf_dir):
    return quality.value_checks(features(spark, sf_dir), _V).withColumns({c: F.round(c, 2) for c in ("min", "max")})


@query("""SELECT 'credit_score' AS "check", 'warning' AS severity, count(*) FILTER (WHERE credit_score = 9999) AS bad_rows FROM og UNION ALL SELECT 'original_dti', 'warning', count(*) FILTER (WHERE original_dti = 999) FROM og UNION ALL SELECT 'occupancy_status', 'warning', count(*) FILTER (WHERE occupancy_status = '9') FROM og""")
def dq5_sentinels(spark, sf_dir):
    return quality.surviving(orig(spark, sf_dir), {"credit_score": 9999, "original_dti": 999, "occupancy_status": "9"})


_C = ["ever_modified", "occupancy_status", "original_dti_missing"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS distinct_values, round((SELECT max(n) FROM (SELECT count(*) AS n FROM mi WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}), 6) AS top_share, CASE WHEN count(DISTINCT {c}) <= 1 THEN 'FAIL' WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM mi WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) >= 0.99 THEN 'WARN' ELSE 'PASS' END AS status FROM mi" for c in _C))
def dq6_constant(spark, sf_dir):
    return R6(quality.constant(features(spark, sf_dir), _C))


@query("SELECT 'future_serious' AS feature, true AS present, 'FAIL' AS status, count(*) AS rows FROM mi UNION ALL SELECT 'recovery_amount', false, 'PASS', count(*) FROM mi")
def dq7_leakage(spark, sf_dir):
    return quality.forbidden(features(spark, sf_dir), ["future_serious", "recovery_amount"])


@query("""SELECT 'dti_indicator' AS "check", 'error' AS severity, count(*) FILTER (WHERE (original_dti IS NULL)::INT <> original_dti_missing) AS bad_rows FROM no""")
def dq8_indicators(spark, sf_dir):
    df = panel.missing_indicators(panel.normalized(orig(spark, sf_dir)))
    return validate.rules(df, {"dti_indicator": ("error", F.col("original_dti").isNull().cast("int") != F.col("original_dti_missing"))})


@query("""SELECT dataset, duplicate_rows, status FROM (SELECT 'orders' AS dataset, (count(*) - count(DISTINCT o_custkey))::BIGINT AS duplicate_rows, CASE WHEN count(*) = count(DISTINCT o_custkey) THEN 'PASS' ELSE 'FAIL' END AS status FROM orders) WHERE status = 'FAIL'""")
def dq9_issues(spark, sf_dir):
    return validate.failed(quality.grain(perf(spark, sf_dir), "performance", "loan_id", "period"), quality.grain(read(spark, sf_dir, "orders"), "orders", "o_custkey"))


def _domains():
    score, ltv = F.col("credit_score"), F.col("estimated_ltv")
    return {"score_domain": ("error", ~score.between(300, 850)), "ltv_sentinel_after_1996": ("warning", (F.col("vintage") > 1996) & (ltv == 999)), "balance_negative": ("error", F.col("current_actual_upb") < 0)}


_DOMAINS = """SELECT 'score_domain' AS "check", 'error' AS severity, count(*) FILTER (WHERE NOT credit_score BETWEEN 300 AND 850) AS bad_rows FROM ms UNION ALL SELECT 'ltv_sentinel_after_1996', 'warning', count(*) FILTER (WHERE vintage > 1996 AND estimated_ltv = 999) FROM ms
UNION ALL SELECT 'balance_negative', 'error', count(*) FILTER (WHERE current_actual_upb < 0) FROM ms"""


@query(_DOMAINS)
def dq11_domains(spark, sf_dir):
    return validate.rules(panel.master(perf(spark, sf_dir), panel.normalized(orig(spark, sf_dir))), _domains())


@query("SELECT occupancy_status, length(occupancy_status) AS code_length, count(*) AS bad_rows FROM og WHERE occupancy_status NOT IN ('A', 'B', 'F', 'H', 'M') OR length(occupancy_status) <> 1 GROUP BY ALL")
def dq12_categories(spark, sf_dir):
    c = F.col("occupancy_status")
    return quality.violations(orig(spark, sf_dir).withColumn("code_length", F.length(c).cast("long")), ~c.isin("A", "B", "F", "H", "M") | (F.length(c) != 1), "occupancy_status", "code_length")


@query("""SELECT 'max_below_current' AS "check", 'error' AS severity, count(*) FILTER (WHERE max_dpd_to_date < dpd) AS bad_rows FROM fu UNION ALL SELECT 'count_above_width', 'error', count(*) FILTER (WHERE delinquency_months_3m > 3) FROM fu UNION ALL SELECT 'streak_without_flag', 'error', count(*) FILTER (WHERE delinquent = 0 AND current_delinquency_streak > 0) FROM fu""")
def dq13_identities(spark, sf_dir):
    f = pit.Frames()
    df = pit.trajectory(pit.lookbacks(pit.lifetime_history(pit.current_state(master(spark, sf_dir).where("calculated_loan_age <= 15")), f), f), f)
    return validate.rules(df, {"max_below_current": ("error", F.col("max_dpd_to_date") < F.col("dpd")), "count_above_width": ("error", F.col("delinquency_months_3m") > 3), "streak_without_flag": ("error", (F.col("delinquent") == 0) & (F.col("current_delinquency_streak") > 0))})


_SCOPED = """d AS (SELECT ms.*, CASE WHEN loan_id % 7 = 0 THEN 'y ' END AS harp_indicator, (loan_id % 62)::INT AS mi_percentage, (CASE WHEN loan_id % 31 = 0 THEN 999 ELSE original_ltv + loan_id % 13 - 2 END)::INT AS original_cltv FROM ms)"""
_KNOWN = {
    "original_dti": ("true", "NOT original_dti BETWEEN 0 AND 65"), "mi_percentage": ("true", "NOT mi_percentage BETWEEN 0 AND 55 AND mi_percentage <> 999"),
    "estimated_ltv": ("true", "NOT estimated_ltv BETWEEN 1 AND 998 AND estimated_ltv <> 999"), "credit_score": ("true", "NOT credit_score BETWEEN 300 AND 850"),
    "ltv_narrow": ("vintage <= 1995 AND coalesce(upper(trim(harp_indicator)) <> 'Y', true)", "NOT original_ltv BETWEEN 6 AND 105 AND original_ltv <> 999"),
    "ltv_relief": ("vintage <= 1995 AND upper(trim(harp_indicator)) = 'Y'", "NOT original_ltv BETWEEN 1 AND 998 AND original_ltv <> 999"), "ltv_wide": ("vintage > 1995", "NOT original_ltv BETWEEN 1 AND 998 AND original_ltv <> 999"),
    "cltv_narrow": ("vintage <= 1995 AND coalesce(upper(trim(harp_indicator)) <> 'Y', true)", "NOT original_cltv BETWEEN 6 AND 200 AND original_cltv <> 999"),
    "cltv_relief": ("vintage <= 1995 AND upper(trim(harp_indicator)) = 'Y'", "NOT original_cltv BETWEEN 1 AND 998 AND original_cltv <> 999"), "cltv_wide": ("vintage > 1995", "NOT original_cltv BETWEEN 1 AND 998 AND original_cltv <> 999"),
    "cltv_not_below_ltv": ("original_cltv <> 999 AND original_ltv <> 999", "original_cltv < original_ltv"),
    **{f"{c}_not_negative": ("true", f"{c} < 0") for c in ("original_upb", "current_actual_upb", "current_interest_rate", "original_interest_rate")},
}


def _counted(known: dict[str, tuple[str, str]], skipped: tuple[str, ...] = ()) -> str:
    parts = [f"SELECT '{k}' AS \"check\", count(*) FILTER (WHERE {scope} AND ({bad}) IS NOT NULL) AS in_scope, count(*) FILTER (WHERE {scope} AND {bad}) AS bad_rows, CASE WHEN count(*) FILTER (WHERE {scope} AND {bad}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM d" for k, (scope, bad) in known.items()]
    return " UNION ALL ".join([*parts, *[f"SELECT '{k}', 0, 0, 'SKIPPED'" for k in skipped]])


@query(f"WITH {_SCOPED} {_counted(_KNOWN, ('delinquency_months_to_date_not_negative', 'max_dpd_to_date_not_negative'))}")
def dq11_scoped_domains(spark, sf_dir):
    """Domains by vintage and programme, and a combined ratio not below the first; rows of every kind break one."""
    k = F.col("loan_id")
    df = panel.master(perf(spark, sf_dir), panel.normalized(orig(spark, sf_dir))).withColumns({
        "harp_indicator": F.when(k % 7 == 0, "y "), "mi_percentage": (k % 62).cast("int"), "original_cltv": F.when(k % 31 == 0, 999).otherwise(F.col("original_ltv") + k % 13 - 2).cast("int"),
    })
    return rules.checked(df, rules.loan_domains(last_narrow_vintage=1995)).select("check", "in_scope", "bad_rows", "status")


_DERIVED = """d AS (SELECT *, current_actual_upb - original_upb + CASE WHEN loan_id % 11 = 3 AND age = 5 THEN 1 ELSE 0 END AS upb_change, (current_actual_upb - original_upb) / nullif(original_upb, 0) AS upb_pct_change,
  360 AS original_loan_term, 360 - age + 1 + CASE WHEN loan_id % 17 = 0 THEN 1 ELSE 0 END AS remaining, age AS calculated_loan_age FROM fu)"""
_DERIVED_KNOWN = {
    "upb_change": ("true", "abs(upb_change - (current_actual_upb - original_upb)) > 1e-6"), "upb_pct_change": ("original_upb <> 0", "abs(upb_pct_change - upb_change / original_upb) > 1e-6"),
    "max_not_below_current": ("true", "max_dpd_to_date < dpd"), "term": ("true", "original_loan_term <> calculated_loan_age + remaining - 1"),
}


@query(f"WITH {_DERIVED} {_counted(_DERIVED_KNOWN)}")
def dq13_derived_identities(spark, sf_dir):
    """Balance changes, lifetime maximum and term against what they are derived from, with rows altered so that identities break."""
    f = pit.Frames()
    df = panel.composition(pit.lifetime_history(pit.current_state(master(spark, sf_dir).where("calculated_loan_age <= 15")), f))
    k, age = F.col("loan_id"), F.col("calculated_loan_age")
    odd = df.withColumns({"upb_change": F.col("upb_change") + F.when((k % 11 == 3) & (age == 5), 1).otherwise(0), "original_loan_term": F.lit(360), "remaining_months_to_legal_maturity": 360 - age + 1 + F.when(k % 17 == 0, 1).otherwise(0)})
    return rules.checked(odd, rules.loan_identities()).select("check", "in_scope", "bad_rows", "status")


@query("SELECT 'estimated_ltv_from' AS \"check\", vintage, zero_balance_code, count(*) AS bad_rows FROM pf WHERE period < 330 AND estimated_ltv <> 999 GROUP BY ALL")
def dq14_dq15_availability(spark, sf_dir):
    """Ratios that are filled before the month from which they are collected, by vintage and code."""
    return rules.broken(perf(spark, sf_dir), [rules.available_from("estimated_ltv_from", "estimated_ltv", 330, 999)], "vintage", "zero_balance_code")


@query("SELECT 'loan_id' AS feature, 'bigint' AS type, count(loan_id) AS filled FROM og UNION ALL SELECT 'credit_score', 'int', count(credit_score) FROM og UNION ALL SELECT 'original_dti', 'int', count(original_dti) FROM og UNION ALL SELECT 'original_ltv', 'int', count(original_ltv) FROM og UNION ALL SELECT 'property_state', 'string', count(property_state) FROM og UNION ALL SELECT 'occupancy_status', 'string', count(occupancy_status) FROM og")
def dq16_inventory(spark, sf_dir):
    return quality.inventory(orig(spark, sf_dir))


@query(f"""SELECT *, CASE WHEN severity = 'error' AND bad_rows > 0 THEN 'FAIL' WHEN bad_rows > 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM ({_DOMAINS})""")
def dq17_gate(spark, sf_dir):
    return quality.gate(dq11_domains(spark, sf_dir))
