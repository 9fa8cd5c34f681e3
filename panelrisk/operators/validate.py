"""Checks as DataFrames: one long row for each check, with severity and number of bad rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """check, severity, bad_rows for predicates that mark bad rows; all in one aggregate over df."""
    one = df.agg(*[F.count_if(c).alias(name) for name, (_, c) in checks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.col(f"`{n}`").alias("bad_rows")) for n, (s, _) in checks.items()]))
    return one.select(rows.alias("x")).select("x.*")


def key_checks(df: DataFrame, key: str) -> DataFrame:
    """Null and blank keys."""
    c = F.col(key).cast("string")
    return rules(df, {f"{key}_null": ("error", c.isNull()), f"{key}_blank": ("error", F.trim(c) == "")})


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """keys and n of keys that more than one row has, over the whole table."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct keys of child that parent lacks."""
    return child.select(key).distinct().join(parent, key, "left_anti")


def failed(*reports: DataFrame) -> DataFrame:
    """Rows of all reports whose status is WARN or FAIL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports).where("status IN ('WARN', 'FAIL')")


def require(report: DataFrame) -> None:
    """Raise once, with all errors of a report."""
    if bad := report.where("severity = 'error' AND bad_rows > 0").collect():
        raise ValueError("; ".join(f"{r['check']}: {r['bad_rows']}" for r in bad))
