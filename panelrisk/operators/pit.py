"""Point-in-time features and the forward target as one block of window expressions.

Every window is partitioned by the loan and ordered by its age, so that Spark plans one exchange and one sort for all of
them. Look-backs and the target go by age (missing months count as absent), lifetime history and episodes go by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.functions.scalar import dpd, is_serious, is_yes

AGES, LOOKBACKS, HORIZON = (3, 6, 9, 12), (3, 12), 3
FLAGS = {"modification": "modification_flag", "payment_deferral": "payment_deferral_flag", "borrower_assistance": "borrower_assistance_plan", "disaster_delinquency": "delinquency_due_to_disaster", "rate_step": "interest_rate_step_indicator"}


class Frames:
    """Window frames of one entity key and clock."""

    def __init__(self, key: str = "loan_id", clock: str = "calculated_loan_age"):
        self.w = Window.partitionBy(key).orderBy(clock)
        self.life = self.w.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.w.rowsBetween(Window.unboundedPreceding, -1)

    def ages(self, lo: int, hi: int):
        return self.w.rangeBetween(lo, hi)


def current_state(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """dpd, dpd_30, dpd_60, delinquent, serious and one 0/1 column for each Y flag."""
    status = F.col("current_loan_delinquency_status")
    d = dpd(status)
    at_least = lambda x: F.coalesce((d >= x).cast("int"), F.lit(0))
    return df.withColumns({"dpd": d, "dpd_30": at_least(1), "dpd_60": at_least(2), "delinquent": at_least(1), "serious": is_serious(status, threshold)} | {f"is_{k}": is_yes(F.col(c)) for k, c in FLAGS.items()})


def lifetime_history(df: DataFrame, f: Frames) -> DataFrame:
    age, over = F.col("calculated_loan_age"), lambda c: F.max(c).over(f.life)
    since = lambda flag: age - over(F.when(F.col(flag) == 1, age))
    return df.withColumns({
        "max_dpd_to_date": over("dpd"), "ever_30dpd_to_date": over("dpd_30"), "ever_60dpd_to_date": over("dpd_60"), "delinquency_months_to_date": F.sum("delinquent").over(f.life).cast("int"),
        "ever_modified": over("is_modification"), "ever_payment_deferred": over("is_payment_deferral"), "ever_borrower_assistance": over("is_borrower_assistance"), "ever_disaster_delinquency": over("is_disaster_delinquency"),
        "months_since_last_delinquency": since("delinquent"), "months_since_last_30dpd": since("dpd_30"), "months_since_last_60dpd": since("dpd_60"), "has_prior_serious": over("serious"),
    })


def lookbacks(df: DataFrame, f: Frames, widths: tuple[int, ...] = LOOKBACKS) -> DataFrame:
    out: dict[str, Column] = {}
    for w in widths:
        frame = f.ages(-(w - 1), 0)
        out |= {f"dpd_30_count_{w}m": F.sum("dpd_30").over(frame).cast("int"), f"dpd_60_count_{w}m": F.sum("dpd_60").over(frame).cast("int"), f"max_dpd_{w}m": F.max("dpd").over(frame), f"delinquency_months_{w}m": F.sum("delinquent").over(frame).cast("int")}
        out |= {f"{k}_count_{w}m": F.sum(f"is_{k}").over(frame).cast("int") for k in FLAGS}
    return df.withColumns(out)


def slope(frame) -> Column:
    """Least-squares slope of dpd on age in a frame; null for fewer than two points or one age."""
    x, y = F.when(F.col("dpd").isNotNull(), F.col("calculated_loan_age").cast("double")), F.col("dpd")
    n, sx, sy = F.count("dpd").over(frame), F.sum(x).over(frame), F.sum(y).over(frame)
    sxy, sxx = F.sum(x * y).over(frame), F.sum(x * x).over(frame)
    below = n * sxx - sx * sx
    return F.when((n >= 2) & (below != 0), (n * sxy - sx * sy) / below)


def trajectory(df: DataFrame, f: Frames) -> DataFrame:
    """Streaks, trends, episodes and relapses."""
    age, flag = F.col("calculated_loan_age"), F.col("delinquent")
    recent, prior = f.ages(-5, 0), f.ages(-11, -6)
    df = df.withColumns({
        "current_delinquency_streak": F.when(flag == 1, age - F.coalesce(F.max(F.when(flag == 0, age)).over(f.life), age - 1)).otherwise(0).cast("int"),
        "dpd_trend_6m": slope(recent), "delinquency_intensity_change_6m": (F.sum("delinquent").over(recent) - F.sum("delinquent").over(prior)).cast("int"),
        "dpd_severity_change_6m": F.avg("dpd").over(recent) - F.avg("dpd").over(prior), "dpd_acceleration_6m": slope(f.ages(-2, 0)) - slope(f.ages(-5, -3)),
        "_starts": F.when((flag == 1) & (F.coalesce(F.lag("delinquent").over(f.w), F.lit(0)) == 0), 1).otherwise(0),
        "_recovers": F.when((flag == 0) & (F.max("delinquent").over(f.before) == 1), 1).otherwise(0),
    })
    return df.withColumns({
        "max_delinquency_streak_12m": F.max(F.least("current_delinquency_streak", F.lit(12))).over(f.ages(-11, 0)), "delinquency_episode_count": F.sum("_starts").over(f.life).cast("int"),
        "relapse_after_current": F.when((flag == 1) & (F.max("_recovers").over(f.before) == 1), 1).otherwise(0),
    }).drop("_starts", "_recovers")


def forward_target(df: DataFrame, f: Frames, horizon: int = HORIZON, payoff: str = "01") -> DataFrame:
    """future_serious, future_last_age, future_zbc, completed_horizon, voluntary_early_payoff, is_outcome_observable, future_90dpd."""
    ahead, end = f.ages(1, horizon), F.col("calculated_loan_age") + horizon
    df = df.withColumns({"future_serious": F.coalesce(F.max("serious").over(ahead), F.lit(False)), "future_last_age": F.max("calculated_loan_age").over(ahead), "future_zbc": F.last("zero_balance_code", ignorenulls=True).over(ahead)})
    df = df.withColumns({"completed_horizon": F.coalesce(F.col("future_last_age") >= end, F.lit(False)), "voluntary_early_payoff": F.coalesce((F.col("future_last_age") < end) & (F.col("future_zbc") == payoff), F.lit(False))})
    return df.withColumns({"is_outcome_observable": F.col("future_serious") | F.col("completed_horizon") | F.col("voluntary_early_payoff"), "future_90dpd": F.col("future_serious").cast("int")})


def at_ages(df: DataFrame, ages: tuple[int, ...] = AGES) -> DataFrame:
    return df.where(F.col("calculated_loan_age").isin(*ages)).withColumn("observation_age", F.col("calculated_loan_age"))


def risk_set(df: DataFrame, ages: tuple[int, ...] = AGES) -> DataFrame:
    """Rows at the observation ages of loans that were never serious and are not terminated."""
    return at_ages(df, ages).where(~F.col("has_prior_serious") & F.col("zero_balance_code").isNull())


def model_input(master: DataFrame, ages: tuple[int, ...] = AGES, widths: tuple[int, ...] = LOOKBACKS, horizon: int = HORIZON) -> DataFrame:
    """Features and target of every loan in the risk set whose outcome can be observed, in one window block.

    Rows later than the last age plus the horizon cannot matter and are left out before the windows. (loan_id,
    calculated_loan_age) must be unique: see validate.duplicate_keys.
    """
    f = Frames()
    df = current_state(master.where(F.col("calculated_loan_age") <= max(ages) + horizon))
    df = forward_target(trajectory(lookbacks(lifetime_history(df, f), f, widths), f), f, horizon)
    return risk_set(df, ages).where("is_outcome_observable")


def origination_target(perf: DataFrame, start_limit: int = 1, horizon: int = 24, threshold: float = 3.0, payoff: str = "01") -> DataFrame:
    """loan_id, ever_90dpd: whether a loan was serious in its first months, for loans that start in time and can be observed."""
    serious = is_serious(F.col("current_loan_delinquency_status"), threshold)
    inside = F.col("calculated_loan_age") <= horizon
    out = perf.groupBy("loan_id").agg(
        F.min("calculated_loan_age").alias("first_age"), F.max(F.when(inside, serious)).alias("ever"), F.max(F.when(inside, F.col("calculated_loan_age"))).alias("last_age"),
        F.max_by("zero_balance_code", F.when(inside & F.col("zero_balance_code").isNotNull(), F.col("calculated_loan_age"))).alias("zbc"),
    )
    observable = F.coalesce(F.col("ever"), F.lit(False)) | (F.col("last_age") >= horizon) | F.coalesce((F.col("last_age") < horizon) & (F.col("zbc") == payoff), F.lit(False))
    return out.where((F.col("first_age") <= start_limit) & observable).select("loan_id", F.coalesce("ever", F.lit(False)).cast("int").alias(f"ever_90dpd_{horizon}m"))
