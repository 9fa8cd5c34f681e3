"""Queries on the window operators, the risk set and the forward target."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelrisk.functions import scalar
from panelrisk.operators import panel, pit
from panelrisk.queries.base import clock, features, master, orig, perf, query, read

R6 = lambda c: F.round(c, 6).alias(c)
KEY = ["loan_id", "calculated_loan_age"]
SKEY = "loan_id, age AS calculated_loan_age"


def state(spark, sf_dir):
    return pit.current_state(master(spark, sf_dir).where("calculated_loan_age <= 15"))


def block(spark, sf_dir):
    f = pit.Frames()
    return pit.forward_target(pit.trajectory(pit.lookbacks(pit.lifetime_history(state(spark, sf_dir), f), f), f), f)


@query("SELECT vintage, observation_age, count(*) AS observations, sum(future_90dpd)::BIGINT AS events, round(avg(future_90dpd), 6) AS event_rate FROM mi GROUP BY ALL")
def ag4_event_rate(spark, sf_dir):
    return features(spark, sf_dir).groupBy("vintage", "observation_age").agg(F.count(F.lit(1)).alias("observations"), F.sum("future_90dpd").cast("long").alias("events"), F.round(F.avg("future_90dpd"), 6).alias("event_rate"))


@query("SELECT loan_id, period, age AS calculated_loan_age FROM pf")
def prj6_loan_age(spark, sf_dir):
    return clock(spark, sf_dir).select("loan_id", "period", "calculated_loan_age")


@query(f"SELECT {SKEY}, dpd, dpd_30, dpd_60, delinquent FROM cs")
def prj7_status(spark, sf_dir):
    return state(spark, sf_dir).select(*KEY, "dpd", "dpd_30", "dpd_60", "delinquent")


@query(f"SELECT {SKEY}, serious::INT AS serious FROM cs")
def prj8_serious(spark, sf_dir):
    return state(spark, sf_dir).select(*KEY, F.col("serious").cast("int").alias("serious"))


@query(f"SELECT {SKEY}, is_modification, is_payment_deferral, is_borrower_assistance, is_disaster_delinquency, is_rate_step FROM cs")
def prj9_flags(spark, sf_dir):
    return state(spark, sf_dir).select(*KEY, *[f"is_{k}" for k in pit.FLAGS])


@query(f"""SELECT {SKEY}, round(current_non_interest_bearing_upb / nullif(current_actual_upb, 0), 6) AS non_interest_share, round(current_interest_bearing_upb / nullif(current_actual_upb, 0), 6) AS interest_share FROM pf""")
def prj10_balance_shares(spark, sf_dir):
    return panel.composition(clock(spark, sf_dir)).select(*KEY, R6("non_interest_share"), R6("interest_share"))


@query(f"SELECT {SKEY}, period - ddlpi AS months_since_paid, (period - ddlpi < 0)::INT AS is_ahead FROM pf")
def prj11_months_since_paid(spark, sf_dir):
    return panel.composition(clock(spark, sf_dir)).select(*KEY, "months_since_paid", "is_ahead")


@query(f"""SELECT {SKEY}, round(current_actual_upb - original_upb, 2) AS upb_change, round((current_actual_upb - original_upb) / nullif(original_upb, 0), 6) AS upb_pct_change, round(current_interest_rate - original_interest_rate, 6) + 0.0 AS rate_change FROM pf""")
def prj12_changes(spark, sf_dir):
    return panel.composition(clock(spark, sf_dir)).select(*KEY, F.round("upb_change", 2).alias("upb_change"), R6("upb_pct_change"), (F.round("rate_change", 6) + 0.0).alias("rate_change"))


@query("SELECT loan_id, CASE WHEN credit_score < 580 THEN 'low' WHEN credit_score < 720 THEN 'mid' WHEN credit_score >= 720 THEN 'high' END AS score_band FROM no")
def prj13_bands(spark, sf_dir):
    inf = float("inf")
    return panel.normalized(orig(spark, sf_dir)).select("loan_id", scalar.band(F.col("credit_score"), [-inf, 580, 720, inf], ["low", "mid", "high"]).alias("score_band"))


@query("SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price FROM orders WHERE o_totalprice > 0")
def prj14_log(spark, sf_dir):
    return read(spark, sf_dir, "orders").where("o_totalprice > 0").select("o_orderkey", F.round(F.log("o_totalprice"), 6).alias("log_price"))


@query("SELECT loan_id, credit_score::DOUBLE * original_ltv AS score_x_ltv FROM no")
def prj15_product(spark, sf_dir):
    return panel.normalized(orig(spark, sf_dir)).select("loan_id", (scalar.to_double(F.col("credit_score")) * scalar.to_double(F.col("original_ltv"))).alias("score_x_ltv"))


@query("SELECT loan_id, observation_age, coalesce(occupancy_status, 'Unknown') AS occupancy_status, coalesce(months_since_last_delinquency, -1)::INT AS months_since_last_delinquency FROM mi")
def prj16_unknown(spark, sf_dir):
    return features(spark, sf_dir).select("loan_id", "observation_age", F.coalesce("occupancy_status", F.lit("Unknown")).alias("occupancy_status"), F.coalesce("months_since_last_delinquency", F.lit(-1)).cast("int").alias("months_since_last_delinquency"))


@query("SELECT DISTINCT period, (DATE '1970-01-01' + to_months(period::INT))::DATE AS month_start FROM pf")
def prj18_month_start(spark, sf_dir):
    return perf(spark, sf_dir).select("period", scalar.date_of_month(F.col("period")).alias("month_start")).distinct()


@query("SELECT min(period) AS first_period, max(period) AS last_period, CASE WHEN min(period) >= 190001 AND max(period) <= 299912 THEN 'yyyymm' ELSE 'ordinal' END AS encoding FROM pf")
def prj19_period_encoding(spark, sf_dir):
    return perf(spark, sf_dir).agg(F.min("period").alias("first_period"), F.max("period").alias("last_period")).withColumn("encoding", F.when((F.col("first_period") >= 190001) & (F.col("last_period") <= 299912), "yyyymm").otherwise("ordinal"))


@query("SELECT loan_id, age AS observation_age, vintage FROM fu WHERE age IN (3, 6, 9, 12) AND NOT has_prior_serious AND zero_balance_code IS NULL")
def flt2_risk_set(spark, sf_dir):
    f = pit.Frames()
    return pit.risk_set(pit.lifetime_history(state(spark, sf_dir), f)).select("loan_id", "observation_age", "vintage")


_AGES = "SELECT loan_id, age, current_loan_delinquency_status AS status FROM pf WHERE age <= 15 AND loan_id IN (SELECT c_custkey FROM customer)"


@query(
    f"WITH a AS MATERIALIZED ({_AGES}), l AS (SELECT loan_id, status, age AS future_age, unnest([3, 6, 9, 12]) AS observation_age FROM a) "
    "SELECT l.loan_id, l.observation_age, l.future_age, l.status AS current_loan_delinquency_status FROM l JOIN a ON a.loan_id = l.loan_id AND a.age = l.observation_age WHERE l.future_age - l.observation_age BETWEEN 1 AND 3"
)
def flt4_future_window(spark, sf_dir):
    rows = clock(spark, sf_dir, 15)
    at = F.explode(F.array(*map(F.lit, pit.AGES))).alias("observation_age")
    known = rows.select("loan_id", F.col("calculated_loan_age").alias("observation_age"))
    ahead = rows.select("loan_id", F.col("calculated_loan_age").alias("future_age"), "current_loan_delinquency_status", at).where("future_age BETWEEN observation_age + 1 AND observation_age + 3")
    return ahead.join(known, ["loan_id", "observation_age"], "left_semi").select("loan_id", "observation_age", "future_age", "current_loan_delinquency_status")


def window_query(name: str, *columns: str) -> None:
    """Register a query of some columns of the window block, doubles rounded."""
    real = {"dpd_trend_6m", "dpd_severity_change_6m", "dpd_acceleration_6m"}

    def run(spark, sf_dir):
        return block(spark, sf_dir).select(*KEY, *[R6(c) if c in real else F.col(c) for c in columns])

    run.__name__ = name
    query(f"SELECT {SKEY}, " + ", ".join(f"round({c}, 6) AS {c}" if c in real else c for c in columns) + " FROM fu")(run)


window_query("wn1_lifetime", "max_dpd_to_date", "ever_30dpd_to_date", "ever_60dpd_to_date", "delinquency_months_to_date")
window_query("wn2_ever_flags", "ever_modified", "ever_payment_deferred", "ever_borrower_assistance", "ever_disaster_delinquency")
window_query("wn3_since_last", "months_since_last_delinquency")
window_query("wn4_prior_serious", "has_prior_serious")
for width in pit.LOOKBACKS:
    window_query(f"wn5_lookback_{width}m", *[f"{c}_{width}m" for c in ("dpd_30_count", "dpd_60_count", "max_dpd", "delinquency_months", *[f"{k}_count" for k in pit.FLAGS])])
window_query("wn6_streak", "current_delinquency_streak")
window_query("wn7_max_streak", "max_delinquency_streak_12m")
window_query("wn8_since_30_60", "months_since_last_30dpd", "months_since_last_60dpd")
window_query("wn9_trend", "dpd_trend_6m")
window_query("wn10_intensity", "delinquency_intensity_change_6m")
window_query("wn11_severity", "dpd_severity_change_6m")
window_query("wn12_acceleration", "dpd_acceleration_6m")
window_query("wn13_episodes", "delinquency_episode_count")
window_query("wn14_relapse", "relapse_after_current")
window_query("wn17_observability", "completed_horizon", "voluntary_early_payoff", "future_90dpd")

INPUT = ["max_dpd_to_date", "delinquency_months_to_date", "months_since_last_delinquency", "delinquency_months_12m", "modification_count_12m", "current_delinquency_streak", "max_delinquency_streak_12m", "delinquency_episode_count", "credit_score", "original_dti", "original_dti_missing"]


@query(f"SELECT loan_id, observation_age, vintage, {', '.join(INPUT)} FROM mi")
def wn15_model_features(spark, sf_dir):
    return features(spark, sf_dir).select("loan_id", "observation_age", "vintage", *INPUT)


@query("SELECT loan_id, age AS observation_age, future_90dpd, future_last_age, future_zbc FROM fu WHERE age IN (3, 6, 9, 12) AND (future_serious OR completed_horizon OR voluntary_early_payoff)")
def wn16_forward_target(spark, sf_dir):
    f = pit.Frames()
    return pit.at_ages(pit.forward_target(state(spark, sf_dir), f)).where("is_outcome_observable").select("loan_id", "observation_age", "future_90dpd", "future_last_age", "future_zbc")


@query("""WITH s AS (SELECT loan_id, min(age) AS first_age, bool_or(coalesce(try_cast(current_loan_delinquency_status AS DOUBLE) >= 3, false) OR current_loan_delinquency_status = 'RA') FILTER (WHERE age <= 24) AS ever,
  max(age) FILTER (WHERE age <= 24) AS last_age, arg_max(zero_balance_code, age) FILTER (WHERE age <= 24 AND zero_balance_code IS NOT NULL) AS zbc FROM pf GROUP BY loan_id)
SELECT loan_id, ever::INT AS ever_90dpd_24m FROM s WHERE first_age <= 1 AND (ever OR last_age >= 24 OR coalesce(last_age < 24 AND zbc = '01', false))""")
def wn18_origination_target(spark, sf_dir):
    return pit.origination_target(clock(spark, sf_dir))
