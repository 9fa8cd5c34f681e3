"""Population splits that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.functions.scalar import hash_unit


def yearly(df: DataFrame, train: list[int], test: list[int], oot: list[int], column: str = "vintage") -> DataFrame:
    """df with split: train, test or oot by vintage, other rows left out. Overlapping or unordered lists raise."""
    if {*train} & {*test} or {*test} & {*oot} or {*train} & {*oot}:
        raise ValueError("vintages overlap")
    if train and test and max(train) >= min(test) or test and oot and max(test) >= min(oot):
        raise ValueError("vintages are not in order")
    name = F.when(F.col(column).isin(*train), "train").when(F.col(column).isin(*test), "test").when(F.col(column).isin(*oot), "oot")
    return df.withColumn("split", name).where("split IS NOT NULL")


def grouped(df: DataFrame, key: str, share: float, seed: str = "split") -> DataFrame:
    """df with split: all rows of a key go to validation with probability share, by md5 of the key."""
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    return df.withColumn("split", F.when(hash_unit(F.col(key), seed=seed) < share, "validation").otherwise("train"))


def stratified(df: DataFrame, key: str, label: str, shares: dict[int, float], seed: str = "strata") -> DataFrame:
    """df with split: each class goes to validation with its own share."""
    share = F.coalesce(*[F.when(F.col(label) == k, v) for k, v in shares.items()], F.lit(0.0))
    return df.withColumn("split", F.when(hash_unit(F.col(key), seed=seed) < share, "validation").otherwise("train"))


def guards(df: DataFrame, label: str) -> DataFrame:
    """One row: rows, rows without label, and classes; for the caller to refuse what cannot be trained on."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label).isNull()).alias("null_labels"), F.count_distinct(label).alias("classes"))


def summary(df: DataFrame, label: str, key: str) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("loans"), F.sum(label).cast("long").alias("events"), F.round(F.avg(label), 6).alias("event_rate"))


def dispatch(df: DataFrame, how: str, **options) -> DataFrame:
    """df with split: how is "random" (options of grouped) or "yearly" (options of yearly)."""
    if how not in ("random", "yearly"):
        raise ValueError(f"no split called {how}")
    return (grouped if how == "random" else yearly)(df, **options)


def with_years(df: DataFrame, label: str, key: str, wanted: dict[str, list[int]], column: str = "vintage") -> DataFrame:
    """summary, with the vintages seen in each split and those that were wanted but have no rows."""
    seen = df.groupBy("split").agg(F.min(column).alias("first_vintage"), F.max(column).alias("last_vintage"), F.sort_array(F.collect_set(column)).alias("_seen"))
    asked = F.coalesce(*[F.when(F.col("split") == k, F.array(*[F.lit(v) for v in vs])) for k, vs in wanted.items()])
    return summary(df, label, key).join(seen, "split").withColumn("vintages_without_rows", F.size(F.array_except(asked, "_seen"))).drop("_seen")


def sampled(df: DataFrame, key: str, share: float, seed: str = "bernoulli") -> DataFrame:
    """Each row with the same probability, by md5 of the key; for screening on training rows only."""
    return df.where(hash_unit(F.col(key), seed=seed) < share)


def sampled_by_class(df: DataFrame, key: str, label: str, shares: dict[int, float], seed: str = "class") -> DataFrame:
    """Each class with its own share, by md5 of the key; other classes are left out."""
    return df.where(hash_unit(F.col(key), seed=seed) < F.coalesce(*[F.when(F.col(label) == k, v) for k, v in shares.items()], F.lit(0.0)))
