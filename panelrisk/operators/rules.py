"""Rules on rows: each has a scope (vintages, programme, period) and says which rows of it break the rule; one aggregate for all.

A null in a rule's condition neither breaks it nor counts as checked; rules whose columns a frame lacks are reported as such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """bad: which rows break it; scope: which rows it is for (None: all); needs: the columns that it reads."""

    name: str
    bad: Column
    needs: tuple[str, ...]
    scope: Column | None = None
    severity: str = "error"
    detail: str = ""


def domain(name: str, column: str, low: float, high: float, also: tuple[float, ...] = (), scope: Column | None = None, needs: tuple[str, ...] = (), severity: str = "error") -> Rule:
    """Values lie in [low, high] or are one of `also` (codes for unknown)."""
    c = F.col(column)
    bad = ~c.between(low, high)
    for v in also:
        bad = bad & (c != v)
    return Rule(name, bad, (column, *needs), scope, severity, f"{column} in {low:g}..{high:g}" + (f" or one of {', '.join(f'{v:g}' for v in also)}" if also else ""))


def not_below(name: str, column: str, other: str, unknown: tuple[float, ...] = ()) -> Rule:
    """column >= other, where neither holds a code for unknown."""
    known = F.lit(True)
    for v in unknown:
        known = known & (F.col(column) != v) & (F.col(other) != v)
    return Rule(name, F.col(column) < F.col(other), (column, other), known, "error", f"{column} is not below {other}")


def identity(name: str, left: Column, right: Column, needs: tuple[str, ...], scope: Column | None = None, tolerance: float = 1e-6) -> Rule:
    """left equals right but for the tolerance."""
    return Rule(name, F.abs(left - right) > tolerance, needs, scope, "error", f"equal within {tolerance:g}")


def available_from(name: str, column: str, period: int, unknown: float, severity: str = "error") -> Rule:
    """Before a period the column holds nothing but nulls and the code for unknown."""
    return Rule(name, F.col(column).isNotNull() & (F.col(column) != unknown), (column, "period"), F.col("period") < period, severity, f"{column} known from month {period} on")


# Domains of the origination and monthly columns by vintage and programme, as the files are documented.
def loan_domains(last_narrow_vintage: int = 2017) -> list[Rule]:
    """Usable values of rates, scores and ratios; ratios were narrower up to a vintage, but for loans of the relief programme."""
    relief = F.coalesce(F.upper(F.trim("harp_indicator")) == "Y", F.lit(False))
    early = F.col("vintage") <= last_narrow_vintage
    scope = ("vintage", "harp_indicator")
    return [
        domain("original_dti", "original_dti", 0, 65),
        domain("mi_percentage", "mi_percentage", 0, 55, also=(999,)),
        domain("estimated_ltv", "estimated_ltv", 1, 998, also=(999,)),
        domain("credit_score", "credit_score", 300, 850),
        domain("ltv_narrow", "original_ltv", 6, 105, also=(999,), scope=early & ~relief, needs=scope),
        domain("ltv_relief", "original_ltv", 1, 998, also=(999,), scope=early & relief, needs=scope),
        domain("ltv_wide", "original_ltv", 1, 998, also=(999,), scope=~early, needs=("vintage",)),
        domain("cltv_narrow", "original_cltv", 6, 200, also=(999,), scope=early & ~relief, needs=scope),
        domain("cltv_relief", "original_cltv", 1, 998, also=(999,), scope=early & relief, needs=scope),
        domain("cltv_wide", "original_cltv", 1, 998, also=(999,), scope=~early, needs=("vintage",)),
        not_below("cltv_not_below_ltv", "original_cltv", "original_ltv", unknown=(999,)),
        *[Rule(f"{c}_not_negative", F.col(c) < 0, (c,), None, "error", f"{c} is not negative") for c in ("original_upb", "current_actual_upb", "current_interest_rate", "original_interest_rate", "delinquency_months_to_date", "max_dpd_to_date")],
    ]


def loan_identities() -> list[Rule]:
    """Derived columns follow from those they are derived from."""
    c = F.col
    return [
        identity("upb_change", c("upb_change"), c("current_actual_upb") - c("original_upb"), ("upb_change", "current_actual_upb", "original_upb")),
        identity("upb_pct_change", c("upb_pct_change"), c("upb_change") / F.nullif("original_upb", F.lit(0.0)), ("upb_pct_change", "upb_change", "original_upb"), c("original_upb") != 0),
        Rule("max_not_below_current", c("max_dpd_to_date") < c("dpd"), ("max_dpd_to_date", "dpd")),
        identity("term", c("original_loan_term").cast("double"), (c("calculated_loan_age") + c("remaining_months_to_legal_maturity") - 1).cast("double"), ("original_loan_term", "calculated_loan_age", "remaining_months_to_legal_maturity")),
    ]


def checked(df: DataFrame, rules: list[Rule], *by: str) -> DataFrame:
    """by, check, severity, in_scope, bad_rows, share, status, detail of every rule, from one aggregate over df.

    in_scope counts the rows of the scope in which the condition is known. status: FAIL or REVIEW where an error or a warning has bad rows, else
    PASS; SKIPPED for rules whose columns df lacks.
    """
    here = [r for r in rules if set(r.needs) <= set(df.columns)]
    inside = lambda r: F.coalesce(r.scope if r.scope is not None else F.lit(True), F.lit(False)) & r.bad.isNotNull()
    sums = [c for k, r in enumerate(here) for c in (F.count_if(inside(r)).alias(f"_n{k}"), F.count_if(inside(r) & r.bad).alias(f"_b{k}"))]
    one = (df.groupBy(*by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("_rows"), *sums)
    rows = []
    for r in rules:
        k = here.index(r) if r in here else None
        n, b = (F.col(f"_n{k}"), F.col(f"_b{k}")) if k is not None else (F.lit(0).cast("long"), F.lit(0).cast("long"))
        status = F.lit("SKIPPED") if k is None else F.when(b > 0, "FAIL" if r.severity == "error" else "REVIEW").otherwise("PASS")
        rows.append(F.struct(F.lit(r.name).alias("check"), F.lit(r.severity).alias("severity"), n.alias("in_scope"), b.alias("bad_rows"), (b / F.nullif(n, F.lit(0))).alias("share"), status.alias("status"), F.lit(r.detail).alias("detail")))
    return one.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def broken(df: DataFrame, rules: list[Rule], *by: str) -> DataFrame:
    """check, by, bad_rows: where the rows lie that break rules; only groups that have such rows. df is read once."""
    return checked(df, rules, *by).where("bad_rows > 0").select("check", *by, "bad_rows")
