"""Column expressions shared by the operators; all of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(c: Column) -> Column:
    """Lenient integer: what cannot be read, or is no whole number, is null."""
    d = c.try_cast("double")
    return F.when(d == F.floor(d), d.cast("long"))


def to_double(c: Column) -> Column:
    """Lenient double."""
    return c.try_cast("double")


def to_text(c: Column) -> Column:
    return c.cast("string")


def month_of_yyyymm(c: Column) -> Column:
    """Months since 1970-01 of a yyyyMM text or number; null if it is no month."""
    n = c.cast("string").try_cast("int")
    month = F.pmod(n, F.lit(100))
    return F.when((n >= 100000) & (n <= 999912) & month.between(1, 12), (F.floor(n / 100).cast("long") - 1970) * 12 + month - 1).cast("long")


def month_of_date(c: Column) -> Column:
    """Months since 1970-01 of a date or timestamp."""
    return ((F.year(c) - 1970) * 12 + F.month(c) - 1).cast("long")


def date_of_month(c: Column) -> Column:
    """First day of a month ordinal."""
    return F.add_months(F.lit("1970-01-01").cast("date"), c.cast("int"))


def null_if(c: Column, *sentinels) -> Column:
    """Null for the sentinel values."""
    return F.when(~c.isin(*sentinels), c)


def is_yes(c: Column) -> Column:
    """1 for a Y after trimming and upper-casing, else 0."""
    return F.coalesce((F.upper(F.trim(c)) == "Y").cast("int"), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is null or zero."""
    return F.when(b != 0, a / b)


def dpd(status: Column) -> Column:
    """Numeric delinquency of a status code; null for RA, XX and anything else that is no number."""
    return status.try_cast("double")


def is_serious(status: Column, threshold: float = 3.0, codes: tuple[str, ...] = ("RA",)) -> Column:
    """True from the threshold on and for the codes; null counts as false."""
    return F.coalesce((dpd(status) >= threshold) | status.isin(*codes), F.lit(False))


def band(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the left-closed band [edge, next edge) that holds c; null outside of all."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        low = c >= lo if lo > float("-inf") else F.lit(True)
        out = F.when(c.isNotNull() & low & (c < hi if hi < float("inf") else F.lit(True)), label).otherwise(out)
    return out


def hash_unit(*keys: Column, seed: str = "split") -> Column:
    """A number in [0, 1) from the md5 of a seed and keys: the same for any partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def wilson(events: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of events / n."""
    p = ratio(events.cast("double"), n.cast("double"))
    centre, denominator = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / denominator, (centre + half) / denominator
