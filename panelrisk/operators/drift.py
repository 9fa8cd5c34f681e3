"""Drift between populations and association between features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.operators import ordered
from panelrisk.operators.aggregates import unpivoted
from panelrisk.sources.scratch import stored

EPS = 1e-6


def _psi(counts: DataFrame) -> DataFrame:
    """feature, psi of feature, level, base, other (counts)."""
    w = Window.partitionBy("feature")
    share = lambda c: F.greatest(F.lit(EPS), F.col(c) / F.sum(c).over(w))
    own = counts.withColumns({"e": share("base"), "a": share("other")})
    return own.groupBy("feature").agg(F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e"))).alias("psi"))


def numeric_psi(df: DataFrame, is_base: str, columns: list[str], bins: int = 10) -> DataFrame:
    """feature, psi of numeric columns between rows with is_base = 1 and 0, all features in one pass.

    Bins are right-closed between the base's exact quantiles, with open ends; equal edges count once, and a feature with fewer than three has
    a null psi. Nulls are in no bin.
    """
    long = unpivoted(df, [is_base], columns).where("value IS NOT NULL")
    edges = ordered.quantiles(long.where(F.col(is_base) == 1), "value", [k / bins for k in range(bins + 1)], "feature").select("feature", F.array_distinct("quantiles").alias("edges"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    level = ordered.edges_below(inner, F.col("value"), bins + 1)
    counted = long.join(F.broadcast(edges), "feature").where("size(edges) >= 3").withColumn("level", level).groupBy("feature", "level").agg(F.count_if(F.col(is_base) == 1).alias("base"), F.count_if(F.col(is_base) == 0).alias("other"))
    return edges.select("feature").join(_psi(counted), "feature", "left")


def categorical_psi(df: DataFrame, is_base: str, columns: list[str]) -> DataFrame:
    """feature, psi over levels; null is a level of its own."""
    long = unpivoted(df, [is_base], columns, "string").withColumn("level", F.coalesce("value", F.lit("__NULL__")))
    return _psi(long.groupBy("feature", "level").agg(F.count_if(F.col(is_base) == 1).alias("base"), F.count_if(F.col(is_base) == 0).alias("other")))


def standardized(df: DataFrame, period: str, segment: str, label: str, base: int) -> DataFrame:
    """period, raw_rate, standard_rate, mix_effect and its per cent of the raw rate: rates re-weighted by the segment mix of the base period."""
    rates = df.groupBy(period, segment).agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate"))
    mix = rates.where(F.col(period) == base).select(segment, (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("weight"))
    out = rates.join(mix, segment, "left").groupBy(period).agg((F.sum(F.col("n") * F.col("rate")) / F.sum("n")).alias("raw_rate"), (F.sum(F.col("weight") * F.col("rate")) / F.sum("weight")).alias("standard_rate"))
    effect = F.col("raw_rate") - F.col("standard_rate")
    return out.withColumns({"mix_effect": effect, "mix_effect_pct": 100 * effect / F.nullif("raw_rate", F.lit(0.0))})


def average_ranks(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key and each column's rank, equal values sharing their average rank; values are counted before they are ordered.

    Ranks go back to the rows column by column, by their value: broadcast for columns of up to ordered.FEW different values, so that
    rows are shuffled only for columns of more. df is read twice and must have no nulls in columns.
    """
    counts = unpivoted(df, [], columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    ranks = stored(ordered.running(counts, "value", ["c"], "feature").select("feature", "value", (F.col("cum_c") - (F.col("c") - 1) / 2).alias("rank")), "ranks")
    many = {r["feature"]: r["count"] for r in ranks.groupBy("feature").count().collect()}  # one row for each column
    out = df.select(*key, *[F.col(c).cast("double").alias(c) for c in columns])
    for k, c in enumerate(columns):
        own = ranks.where(F.col("feature") == c).select(F.col("value").alias(f"_v{k}"), F.col("rank").alias(f"_r{k}"))
        out = out.join(F.broadcast(own) if many.get(c, 0) <= ordered.FEW else own, F.col(c) == F.col(f"_v{k}"))
    return out.select(*key, *[F.col(f"_r{k}").alias(c) for k, c in enumerate(columns)])


def spearman(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """a, b, rho for every pair of columns, over rows without nulls in them."""
    ranked = average_ranks(df.dropna(subset=columns), key, columns)
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = ranked.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs]))
    return one.select(rows.alias("x")).select("x.*")


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: v, the bias-corrected Cramér's V of two categorical columns; rows with nulls are left out."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))
    m = cells.withColumns({"ra": F.sum("n").over(Window.partitionBy("a")), "rb": F.sum("n").over(Window.partitionBy("b")), "t": F.sum("n").over(whole)})
    s = m.agg((F.max("t") * (F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("rb"))) - 1)).alias("chi2"), F.max("t").alias("t"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"))
    t, r, k = F.col("t"), F.col("r"), F.col("k")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / t - (k - 1) * (r - 1) / (t - 1))
    rc, kc = r - (r - 1) ** 2 / (t - 1), k - (k - 1) ** 2 / (t - 1)
    least = F.least(kc - 1, rc - 1)
    return s.select(F.when(least > 0, F.sqrt(phi / least)).otherwise(F.lit(0.0)).alias("v"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """One row: eta, the share of the value's deviation between categories, as a root."""
    g = df.where(F.col(category).isNotNull() & F.col(value).isNotNull()).groupBy(category).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.sum(F.col(value).cast("double") ** 2).alias("q"))
    s = g.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") ** 2).alias("b"), F.sum("q").alias("q"))
    mean = F.col("s") ** 2 / F.col("n")
    return s.select(F.when(F.col("q") > mean, F.sqrt((F.col("b") - mean) / (F.col("q") - mean))).otherwise(F.lit(0.0)).alias("eta"))
