"""Profiles and cohort tables over any DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.operators import ordered


def event_rates(df: DataFrame, label: str, key: str, *by: str) -> DataFrame:
    """Observations, distinct keys, events, rate and share of all observations, by any columns."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("observations"), F.count_distinct(key).alias("loans"), F.sum(label).cast("long").alias("events"), F.avg(label).alias("event_rate"))
    return out.withColumn("share", F.col("observations") / F.sum("observations").over(Window.partitionBy(F.lit(1))))


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], kind: str = "double", name: str = "feature", value: str = "value") -> DataFrame:
    """keys, feature, value in long form; one pass over df."""
    own = df.select(*keys, *[F.col(c).cast(kind).alias(c) for c in columns])
    return own.unpivot(keys, columns, name, value)


def profiled(long: DataFrame, by: list[str], stats: list[Column], shares: dict[str, float], value: str = "value") -> DataFrame:
    """by, stats over the rows of each group, and exact quantiles of value by name.

    Quantiles run over ranges of the different values, so that no buffer holds those of a column. long is read twice. A group without values has nulls.
    """
    q = ordered.quantiles(long, value, list(shares.values()), *by)
    named = q.select(*[F.col(k).alias(f"_{k}") for k in by], *[F.get("quantiles", F.lit(k)).alias(n) for k, n in enumerate(shares)])
    own, same = long.groupBy(*by).agg(*stats, F.count(F.lit(1)).alias("_rows")).drop("_rows"), F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return own.join(named if by else F.broadcast(named), same, "left").drop(*[f"_{k}" for k in by])


def numeric_profile(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean, deviation, extremes, exact quantiles and missing values of each column; df is read twice."""
    v = F.col("value")
    stats = [F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")]
    return profiled(unpivoted(df, [], columns), ["feature"], stats, {f"p{round(100 * q):02d}": q for q in quantiles})


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, bias-adjusted skewness and quartiles; df is read twice."""
    v, n = F.col("value"), F.count("value")
    stats = [F.avg(v).alias("mean"), F.stddev(v).alias("std"), (F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew")]
    return profiled(unpivoted(df, [], columns), ["feature"], stats, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return unpivoted(df, [], columns, "string").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values, missing rows, and the most frequent value (the least of equals) with its share of rows that have one."""
    counts = level_counts(df, columns)
    known = F.col("value").isNotNull()
    top = F.max(F.when(known, F.col("n")))
    out = counts.groupBy("feature").agg(
        F.count_if(known).alias("distinct_values"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"), top.alias("top_count"), F.sum(F.when(known, F.col("n"))).alias("known"),
    )
    first = counts.where(known).join(out.select("feature", "top_count"), "feature").where("n = top_count").groupBy("feature").agg(F.min("value").alias("top_value"))
    return out.join(first, "feature", "left").select("feature", "distinct_values", "missing", "top_value", "top_count", (F.col("top_count") / F.col("known")).alias("top_share"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, missing, share: one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["_n"], columns, "feature", "missing").select("feature", "missing", (F.col("missing") / F.col("_n")).alias("share"))


def share_of(c: str, *by: str) -> Column:
    """c over its sum in the group."""
    return F.col(c) / F.sum(c).over(Window.partitionBy(*by))


def pivoted(df: DataFrame, row: str, column: str, values: list, what: Column) -> DataFrame:
    """A matrix; the column's values are given, so that no job looks for them."""
    return df.groupBy(row).pivot(column, values).agg(what)
