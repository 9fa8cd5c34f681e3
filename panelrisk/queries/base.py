"""Registry, inputs of the queries, and the SQL that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.operators import panel, pit
from panelrisk.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(sql)
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def perf(spark: SparkSession, sf_dir: str, dense: bool = True, last_age: int | None = None) -> DataFrame:
    return panel.performance(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), dense, last_age)


def orig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.origination(read(spark, sf_dir, "customer"))


def master(spark: SparkSession, sf_dir: str, last_age: int | None = None) -> DataFrame:
    return panel.master(perf(spark, sf_dir, last_age=last_age), panel.missing_indicators(panel.normalized(orig(spark, sf_dir))))


def clock(spark: SparkSession, sf_dir: str, last: int | None = None) -> DataFrame:
    """The panel with its age; up to an age."""
    df = panel.with_age(perf(spark, sf_dir))
    return df if last is None else df.where(F.col("calculated_loan_age") <= last)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model input, from the ages that it looks at."""
    return pit.model_input(master(spark, sf_dir, max(pit.AGES) + pit.HORIZON))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, label and a deterministic PD, a rounded formula over features; nearly all rows differ in it."""
    z = F.lit(-4.0) + 0.8 * F.coalesce("max_dpd_to_date", F.lit(0.0)) + 0.15 * F.col("delinquency_months_12m") + 0.01 * (F.col("original_ltv") - 75) + 0.3 * F.col("current_delinquency_streak") + 1e-7 * F.col("current_actual_upb")
    return features(spark, sf_dir).select(
        "loan_id", "observation_age", "vintage", "period", "current_actual_upb", F.col("future_90dpd").alias("label"), F.round(1 / (1 + F.exp(-z)), 10).alias("pd"),
    )


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored, written once: metrics read it several times."""
    return stored(scored(spark, sf_dir), "scored")


def feature_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of features, written once."""
    return stored(features(spark, sf_dir).select(*columns), "features")


#: Shared SQL, by name; each may use those before it.
TABLES = {
    "ln": "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, sum(l_discount) AS d, count(*) AS n, sum(l_extendedprice * l_discount) AS nib, max(l_quantity) AS q, max(l_tax) AS tax FROM lineitem GROUP BY l_orderkey",
    "mo": """SELECT o_custkey AS loan_id, (year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS period, sum(o_totalprice) AS price, coalesce(sum(r), 0) AS r, sum(d) / sum(n) AS disc, sum(nib) AS nib,
        max((o_orderpriority = '1-URGENT')::INT) AS urgent, max((o_orderpriority = '2-HIGH')::INT) AS high, max(q) AS q, max(tax) AS tax, max(o_orderstatus) AS st
        FROM orders LEFT JOIN ln ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "gr": "SELECT loan_id, p0, p1, unnest(range(p0, p1 + 1)) AS period FROM (SELECT loan_id, min(period) AS p0, max(period) AS p1 FROM mo GROUP BY loan_id)",
    "pf": """SELECT loan_id, period, p0 AS first_payment_date, (1970 + p0 // 12)::INT AS vintage,
        CASE WHEN coalesce(r, 0) >= 7 THEN 'RA' WHEN price IS NULL AND period % 12 = 0 THEN 'XX' ELSE lpad(coalesce(r, 0)::BIGINT::VARCHAR, 2, '0') END AS current_loan_delinquency_status,
        CASE WHEN period = p1 AND st = 'F' THEN '01' WHEN period = p1 AND st = 'P' THEN '03' END AS zero_balance_code,
        first_value(price) OVER w AS original_upb, sum(coalesce(price, 0)) OVER w AS current_actual_upb, 100 * first_value(disc) OVER w AS original_interest_rate, 100 * last_value(disc IGNORE NULLS) OVER w AS current_interest_rate,
        sum(coalesce(nib, 0)) OVER w AS current_non_interest_bearing_upb, sum(coalesce(price, 0)) OVER w - sum(coalesce(nib, 0)) OVER w AS current_interest_bearing_upb,
        max(CASE WHEN coalesce(r, 0) = 0 THEN period END) OVER w AS ddlpi,
        CASE WHEN urgent = 1 THEN 'Y' END AS payment_deferral_flag, CASE WHEN high = 1 THEN 'Y' END AS borrower_assistance_plan, CASE WHEN q >= 45 THEN 'Y' END AS modification_flag,
        CASE WHEN tax >= 0.07 THEN 'Y' END AS interest_rate_step_indicator, CASE WHEN coalesce(r, 0) >= 2 AND period % 12 = 8 THEN 'Y' END AS delinquency_due_to_disaster,
        (CASE WHEN (loan_id + period) % 29 = 0 THEN 999 ELSE 50 + loan_id * 7 % 60 END)::INT AS estimated_ltv, (period - p0 + 1)::INT AS age
        FROM gr LEFT JOIN mo USING (loan_id, period) WINDOW w AS (PARTITION BY loan_id ORDER BY period ROWS UNBOUNDED PRECEDING)""",
    "og": """SELECT c_custkey AS loan_id, (CASE WHEN c_custkey % 50 = 0 THEN 9999 ELSE 300 + floor((c_acctbal + 1000) / 11000 * 550) END)::INT AS credit_score, (CASE WHEN c_custkey % 37 = 0 THEN 999 ELSE c_custkey % 66 END)::INT AS original_dti,
        (50 + c_custkey % 55)::INT AS original_ltv, c_nationkey::VARCHAR AS property_state, CASE WHEN c_custkey % 41 = 0 THEN '9' ELSE left(c_mktsegment, 1) END AS occupancy_status FROM customer""",
    "no": "SELECT loan_id, nullif(credit_score, 9999) AS credit_score, nullif(original_dti, 999) AS original_dti, nullif(original_ltv, 999) AS original_ltv, property_state, nullif(occupancy_status, '9') AS occupancy_status, (nullif(original_dti, 999) IS NULL)::INT AS original_dti_missing FROM og",
    "ms": "SELECT pf.*, no.* EXCLUDE (loan_id) FROM pf JOIN no USING (loan_id)",
    "cs": """SELECT *, try_cast(current_loan_delinquency_status AS DOUBLE) AS dpd, coalesce((try_cast(current_loan_delinquency_status AS DOUBLE) >= 1)::INT, 0) AS dpd_30, coalesce((try_cast(current_loan_delinquency_status AS DOUBLE) >= 2)::INT, 0) AS dpd_60,
        coalesce((try_cast(current_loan_delinquency_status AS DOUBLE) >= 1)::INT, 0) AS delinquent, coalesce(try_cast(current_loan_delinquency_status AS DOUBLE) >= 3, false) OR current_loan_delinquency_status = 'RA' AS serious,
        coalesce((upper(trim(modification_flag)) = 'Y')::INT, 0) AS is_modification, coalesce((upper(trim(payment_deferral_flag)) = 'Y')::INT, 0) AS is_payment_deferral, coalesce((upper(trim(borrower_assistance_plan)) = 'Y')::INT, 0) AS is_borrower_assistance,
        coalesce((upper(trim(delinquency_due_to_disaster)) = 'Y')::INT, 0) AS is_disaster_delinquency, coalesce((upper(trim(interest_rate_step_indicator)) = 'Y')::INT, 0) AS is_rate_step FROM ms WHERE age <= 15""",
}
_count = lambda c, w: f"sum({c}) OVER (PARTITION BY loan_id ORDER BY age RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)::INT"
_slope = lambda w: f"""CASE WHEN count(dpd) OVER {w} >= 2 AND count(dpd) OVER {w} * sum(CASE WHEN dpd IS NOT NULL THEN age * age END) OVER {w} <> (sum(CASE WHEN dpd IS NOT NULL THEN age END) OVER {w}) ** 2 THEN
    (count(dpd) OVER {w} * sum(age * dpd) OVER {w} - sum(CASE WHEN dpd IS NOT NULL THEN age END) OVER {w} * sum(dpd) OVER {w})
    / (count(dpd) OVER {w} * sum(CASE WHEN dpd IS NOT NULL THEN age * age END) OVER {w} - (sum(CASE WHEN dpd IS NOT NULL THEN age END) OVER {w}) ** 2)::DOUBLE END"""  # noqa: E731
_look = ", ".join(
    f"{_count('dpd_30', w)} AS dpd_30_count_{w}m, {_count('dpd_60', w)} AS dpd_60_count_{w}m, max(dpd) OVER (PARTITION BY loan_id ORDER BY age RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS max_dpd_{w}m, {_count('delinquent', w)} AS delinquency_months_{w}m, "
    + ", ".join(f"{_count('is_' + k, w)} AS {k}_count_{w}m" for k in pit.FLAGS)
    for w in pit.LOOKBACKS
)
TABLES |= {
    "ft": f"""SELECT *, max(dpd) OVER l AS max_dpd_to_date, max(dpd_30) OVER l AS ever_30dpd_to_date, max(dpd_60) OVER l AS ever_60dpd_to_date, sum(delinquent) OVER l::INT AS delinquency_months_to_date,
        max(is_modification) OVER l AS ever_modified, max(is_payment_deferral) OVER l AS ever_payment_deferred, max(is_borrower_assistance) OVER l AS ever_borrower_assistance, max(is_disaster_delinquency) OVER l AS ever_disaster_delinquency,
        age - max(CASE WHEN delinquent = 1 THEN age END) OVER l AS months_since_last_delinquency, age - max(CASE WHEN dpd_30 = 1 THEN age END) OVER l AS months_since_last_30dpd, age - max(CASE WHEN dpd_60 = 1 THEN age END) OVER l AS months_since_last_60dpd,
        bool_or(serious) OVER l AS has_prior_serious, {_look},
        (CASE WHEN delinquent = 1 THEN age - coalesce(max(CASE WHEN delinquent = 0 THEN age END) OVER l, age - 1) ELSE 0 END)::INT AS current_delinquency_streak,
        {_slope("a5")} AS dpd_trend_6m, (sum(delinquent) OVER a5 - sum(delinquent) OVER b6)::INT AS delinquency_intensity_change_6m, avg(dpd) OVER a5 - avg(dpd) OVER b6 AS dpd_severity_change_6m, {_slope("a2")} - {_slope("b3")} AS dpd_acceleration_6m,
        CASE WHEN delinquent = 1 AND coalesce(lag(delinquent) OVER (PARTITION BY loan_id ORDER BY age), 0) = 0 THEN 1 ELSE 0 END AS starts,
        CASE WHEN delinquent = 0 AND max(delinquent) OVER p = 1 THEN 1 ELSE 0 END AS recovers,
        coalesce(bool_or(serious) OVER h, false) AS future_serious, max(age) OVER h AS future_last_age, last_value(zero_balance_code IGNORE NULLS) OVER h AS future_zbc
        FROM cs WINDOW l AS (PARTITION BY loan_id ORDER BY age ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY loan_id ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        a5 AS (PARTITION BY loan_id ORDER BY age RANGE BETWEEN 5 PRECEDING AND CURRENT ROW), b6 AS (PARTITION BY loan_id ORDER BY age RANGE BETWEEN 11 PRECEDING AND 6 PRECEDING),
        a2 AS (PARTITION BY loan_id ORDER BY age RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), b3 AS (PARTITION BY loan_id ORDER BY age RANGE BETWEEN 5 PRECEDING AND 3 PRECEDING),
        h AS (PARTITION BY loan_id ORDER BY age RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""",
    "fu": """SELECT * EXCLUDE (starts, recovers), max(least(current_delinquency_streak, 12)) OVER (PARTITION BY loan_id ORDER BY age RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS max_delinquency_streak_12m,
        sum(starts) OVER (PARTITION BY loan_id ORDER BY age ROWS UNBOUNDED PRECEDING)::INT AS delinquency_episode_count,
        CASE WHEN delinquent = 1 AND max(recovers) OVER (PARTITION BY loan_id ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 1 ELSE 0 END AS relapse_after_current,
        coalesce(future_last_age >= age + 3, false) AS completed_horizon, coalesce(future_last_age < age + 3 AND future_zbc = '01', false) AS voluntary_early_payoff, future_serious::INT AS future_90dpd FROM ft""",
    "mi": "SELECT *, age AS observation_age FROM fu WHERE age IN (3, 6, 9, 12) AND NOT has_prior_serious AND zero_balance_code IS NULL AND (future_serious OR completed_horizon OR voluntary_early_payoff)",
    "sc": """SELECT loan_id, observation_age, vintage, period, current_actual_upb, future_90dpd AS label,
        round(1 / (1 + exp(-(-4.0 + 0.8 * coalesce(max_dpd_to_date, 0) + 0.15 * delinquency_months_12m + 0.01 * (original_ltv - 75) + 0.3 * current_delinquency_streak + 1e-7 * current_actual_upb))), 10) AS pd FROM mi""",
}


def with_tables(sql: str) -> str:
    """The SQL behind the shared tables that it names."""
    import re

    wanted, names = set(), list(TABLES)
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in names:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                wanted.add(name)
                todo.append(TABLES[name])
    own = [f"{n} AS ({TABLES[n]})" for n in names if n in wanted]
    if not own:
        return sql
    head = "WITH " + ",\n".join(own)
    recursive = re.match(r"\s*WITH\s+RECURSIVE\b", sql)
    if recursive:
        return head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + sql.strip()[recursive.end() - (len(sql) - len(sql.lstrip())) :]
    return f"{head},\n{sql.strip()[5:]}" if re.match(r"\s*WITH\b", sql) else f"{head}\n{sql}"
