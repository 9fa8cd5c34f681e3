"""The entity by month panel: adapter over orders and lineitem, master join, clock, macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.functions.scalar import month_of_date, null_if, ratio


def monthly_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """loan_id, period and the month's activity; lines are summed up by order before the join."""
    lines = lineitem.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.sum("l_discount").alias("d"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("nib"), F.max("l_quantity").alias("q"), F.max("l_tax").alias("tax"),
    )
    own = orders.select("o_orderkey", F.col("o_custkey").alias("loan_id"), month_of_date(F.col("o_orderdate")).alias("period"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    return own.join(lines, own["o_orderkey"] == lines["l_orderkey"], "left").groupBy("loan_id", "period").agg(
        F.sum("o_totalprice").alias("price"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"), (F.sum("d") / F.sum("n")).alias("disc"), F.sum("nib").alias("nib"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"), F.max((F.col("o_orderpriority") == "2-HIGH").cast("int")).alias("high"),
        F.max("q").alias("q"), F.max("tax").alias("tax"), F.max("o_orderstatus").alias("st"),
    )


def performance(orders: DataFrame, lineitem: DataFrame, dense: bool = True, last_age: int | None = None) -> DataFrame:
    """The monthly performance table. dense: every month from the first to the last, else months with orders alone.

    A month with orders makes those up to the next one, so that orders and lines are read once and the table is not joined with itself.
    With last_age, rows up to that age alone: all columns look back, but for the last month, which the loan's rows tell before they are dealt.
    """
    months = monthly_orders(orders, lineitem).where("period IS NOT NULL")
    own = Window.partitionBy("loan_id").orderBy("period")
    known = months.withColumns({"p0": F.first("period").over(own), "p1": F.max("period").over(Window.partitionBy("loan_id")), "_next": F.lead("period").over(own)})
    end = F.lit(None).cast("long") if last_age is None else F.col("p0") + last_age - 1
    known = known.where(F.coalesce(F.col("period") <= end, F.lit(True)))
    real = F.col("loan_id").isNotNull()  # orders without a loan have months, but no activity
    if dense:
        activity = [F.when((F.col("_month") == F.col("period")) & real, F.col(c)).alias(c) for c in months.columns if c not in ("loan_id", "period")]
        upto = F.least(F.coalesce(F.col("_next") - 1, F.col("period")), end)
        rows = known.withColumn("_month", F.explode(F.sequence(F.col("period").cast("long"), upto.cast("long")))).select("loan_id", "p0", "p1", F.col("_month").cast(known.schema["period"].dataType).alias("period"), *activity)
    else:
        rows = known.where(real).drop("_next")
    w = Window.partitionBy("loan_id").orderBy("period")
    to_date, flag = w.rowsBetween(Window.unboundedPreceding, 0), lambda c: F.when(c, "Y")
    r = F.coalesce("r", F.lit(0))
    rows = rows.withColumns({
        "upb": F.sum(F.coalesce("price", F.lit(0.0))).over(to_date), "nibs": F.sum(F.coalesce("nib", F.lit(0.0))).over(to_date),
        "rate": F.last("disc", ignorenulls=True).over(to_date), "paid": F.max(F.when(r == 0, F.col("period"))).over(to_date),
        "first_upb": F.first("price").over(to_date), "first_rate": F.first("disc").over(to_date),
    })
    last = F.col("period") == F.col("p1")
    return rows.select(
        "loan_id", "period", F.col("p0").alias("first_payment_date"), (F.lit(1970) + F.floor(F.col("p0") / 12)).cast("int").alias("vintage"),
        F.when(r >= 7, "RA").when(F.col("price").isNull() & (F.col("period") % 12 == 0), "XX").otherwise(F.lpad(r.cast("string"), 2, "0")).alias("current_loan_delinquency_status"),
        F.when(last & (F.col("st") == "F"), "01").when(last & (F.col("st") == "P"), "03").alias("zero_balance_code"),
        F.col("first_upb").alias("original_upb"), F.col("upb").alias("current_actual_upb"),
        (100 * F.col("first_rate")).alias("original_interest_rate"), (100 * F.col("rate")).alias("current_interest_rate"),
        F.col("nibs").alias("current_non_interest_bearing_upb"), (F.col("upb") - F.col("nibs")).alias("current_interest_bearing_upb"), F.col("paid").alias("ddlpi"),
        flag(F.col("urgent") == 1).alias("payment_deferral_flag"), flag(F.col("high") == 1).alias("borrower_assistance_plan"),
        flag(F.col("q") >= 45).alias("modification_flag"), flag(F.col("tax") >= 0.07).alias("interest_rate_step_indicator"),
        flag((r >= 2) & (F.col("period") % 12 == 8)).alias("delinquency_due_to_disaster"),
        F.when((F.col("loan_id") + F.col("period")) % 29 == 0, 999).otherwise(50 + F.col("loan_id") * 7 % 60).cast("int").alias("estimated_ltv"),
    )


def origination(customer: DataFrame) -> DataFrame:
    """One row for each loan, sentinels included."""
    k = F.col("c_custkey")
    return customer.select(
        k.alias("loan_id"),
        F.when(k % 50 == 0, 9999).otherwise(300 + F.floor((F.col("c_acctbal") + 1000) / 11000 * 550)).cast("int").alias("credit_score"),
        F.when(k % 37 == 0, 999).otherwise(k % 66).cast("int").alias("original_dti"), (50 + k % 55).cast("int").alias("original_ltv"),
        F.col("c_nationkey").cast("string").alias("property_state"),
        F.when(k % 41 == 0, "9").otherwise(F.substring("c_mktsegment", 1, 1)).alias("occupancy_status"),
    )


# The codes that stand for a missing value, by column; those of the monthly file last.
NUMERIC_SENTINELS = {
    "credit_score": 9999,
    "original_dti": 999,
    "original_ltv": 999,
    "original_cltv": 999,
    "number_of_borrowers": 99,
    "number_of_units": 99,
    "mi_percentage": 999,
    "original_loan_term": 999,
    "estimated_ltv": 999,
}
CATEGORY_SENTINELS = {
    "first_time_homebuyer_flag": "9",
    "property_type": "99",
    "occupancy_status": "9",
    "channel": "9",
    "loan_purpose": "9",
}


def normalized(df: DataFrame) -> DataFrame:
    """Sentinels of known columns become null, in one projection; XX of a delinquency status as well."""
    all_ = NUMERIC_SENTINELS | CATEGORY_SENTINELS | {"current_loan_delinquency_status": "XX"}
    return df.select(*[null_if(F.col(c), all_[c]).alias(c) if c in all_ else F.col(c) for c in df.columns])


def missing_indicators(df: DataFrame, columns: tuple[str, ...] = ("original_dti",)) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def contract(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in this order; raises if one is missing."""
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {gone}")
    return df.select(*columns)


def with_age(df: DataFrame) -> DataFrame:
    """calculated_loan_age: months since the first payment, from 1."""
    return df.withColumn("calculated_loan_age", (F.col("period") - F.col("first_payment_date") + 1).cast("int"))


def master(perf: DataFrame, orig: DataFrame) -> DataFrame:
    """Performance with its loan's origination columns; orig must have unique loan_ids."""
    return with_age(perf).join(orig, "loan_id")


def macro_series(orders: DataFrame) -> DataFrame:
    """One row for each month: mean price and number of orders of the market."""
    return orders.groupBy(month_of_date(F.col("o_orderdate")).alias("period")).agg(F.avg("o_totalprice").alias("market_price"), F.count(F.lit(1)).alias("market_orders"))


def with_macro(df: DataFrame, macro: DataFrame, lag_months: int = 0, most_months: int = 12_000) -> DataFrame:
    """Left join of the month's macro row. Broadcast only after its rows were counted: a month is one row."""
    series = macro.withColumn("period", F.col("period") + lag_months)
    return df.join(F.broadcast(series) if series.limit(most_months + 1).count() <= most_months else series, "period", "left")


def composition(df: DataFrame) -> DataFrame:
    """Shares of the balance, months since the last paid instalment, ahead flag, changes from origination."""
    months = F.col("period") - F.col("ddlpi")
    return df.withColumns({
        "non_interest_share": ratio(F.col("current_non_interest_bearing_upb"), F.col("current_actual_upb")),
        "interest_share": ratio(F.col("current_interest_bearing_upb"), F.col("current_actual_upb")),
        "months_since_paid": months, "is_ahead": F.when(months.isNotNull(), (months < 0).cast("int")),
        "upb_change": F.col("current_actual_upb") - F.col("original_upb"),
        "upb_pct_change": ratio(F.col("current_actual_upb") - F.col("original_upb"), F.col("original_upb")),
        "rate_change": F.col("current_interest_rate") - F.col("original_interest_rate"),
    })


def with_first_payment(df: DataFrame, perf: DataFrame) -> DataFrame:
    """df with the loan's first_payment_date, one for each loan; null where perf does not have the loan."""
    return df.join(perf.groupBy("loan_id").agg(F.min("first_payment_date").alias("first_payment_date")), "loan_id", "left")
