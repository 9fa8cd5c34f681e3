"""Positions, running sums and exact quantiles over an order, without a task that holds a group or a tied value.

Rows are dealt by ranges of the whole sort key (group, value, tie key), sorted and written; what the ranges before a
range hold of its groups, one row for each range and group, is added. A range is the only unit of work, so one
period or one score for all rows is spread over tasks like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.sources.scratch import stored

#: Rows of ranges and groups (some 50 bytes each) up to which they are broadcast; beyond it they join by a shuffle.
FEW = 100_000


def _dealt(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """df in the order of keys, written, with _task, the range of the row, and _at, which grows by 1 from row to row of a range."""
    own = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return stored(own, "ordered").withColumn("_task", F.shiftright("_at", 33))


def _carried(rows: DataFrame, totals: DataFrame, sums: list[str], by: tuple[str, ...]) -> DataFrame:
    """rows with before_<c> and all_<c> of their range and group: what earlier ranges of the group hold, and all do.

    totals: a row for each _task and group. Its window sees the ranges that a group lies in.
    """
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_by_{k}") for k in by], F.col("_task").alias("_of"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums], *[F.sum(c).over(whole).alias(f"all_{c}") for c in sums], *[c for c in totals.columns if c not in (*by, *sums, "_task")],
    )
    same = F.col("_task") == F.col("_of")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    few = not by or totals.count() <= FEW
    return rows.join(F.broadcast(offsets) if few else offsets, same)


def positions(df: DataFrame, order: list[str | Column], *by: str) -> DataFrame:
    """df with position, from 1 on in the order inside each group, and n_rows of the group. Rows that are equal in all keys are in any order."""
    rows = _dealt(df, [*by, *order])
    totals = rows.groupBy("_task", *by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = _carried(rows, totals, ["_n"], by)
    return own.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before__n") + 1).alias("position"), F.col("all__n").alias("n_rows"))


def running(df: DataFrame, value: str, sums: list[str], *by: str, descending: bool = False) -> DataFrame:
    """df with cum_<c>, the sum of c up to the row in the order of value inside its group, and all_<c>, its sum over the group, for each c of sums.

    Rows that share a value are summed one after the other, in any order: give one row for each value.
    """
    rows = _dealt(df, [*by, F.col(value).desc() if descending else F.col(value).asc()])
    inside = Window.partitionBy("_task", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("_task", *by).agg(*[F.sum(c).alias(c) for c in sums])
    own = _carried(rows.withColumns({f"_cum_{c}": F.sum(c).over(inside) for c in sums}), totals, sums, by)
    return own.select(*df.columns, *[(F.col(f"_cum_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sums], *[f"all_{c}" for c in sums])


def edges_below(edges: Column, x: Column, n: int) -> Column:
    """How many of the ascending values of the array edges, n at most, are below x: a binary search that is compiled with the row's other expressions."""

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.get(edges, F.lit(mid)) < x, among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, n)


def quantiles_of(placed: DataFrame, value: str, n: str, shares: list[float], *by: str) -> DataFrame:
    """by, quantiles, from rows that hold a value, how often it occurs (n), and cum_<n>, all_<n> as `running` gives them."""
    first, last = F.col(f"cum_{n}") - F.col(n), F.col(f"cum_{n}") - 1
    # few rows hold one of the positions; the others go before any position is looked at by itself
    some = F.lit(False)
    for q in shares:
        x = F.lit(q) * (F.col(f"all_{n}") - 1)
        some = some | F.floor(x).between(first, last) | F.ceil(x).between(first, last)
    near = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(q) * (F.col(f"all_{n}") - 1)).alias("x")) for k, q in enumerate(shares)])
    hit = lambda s: (F.floor(s["x"]).between(first, last)) | (F.ceil(s["x"]).between(first, last))
    rows = placed.where(some).select(*by, F.col(value).alias("_v"), first.alias("_first"), last.alias("_last"), F.explode(F.filter(near, hit)).alias("_s"))
    lo, hi = (F.max(F.when(f("_s.x").between(F.col("_first"), F.col("_last")), F.col("_v"))) for f in (F.floor, F.ceil))
    each = rows.groupBy(*by, "_s.k").agg(lo.alias("_lo"), hi.alias("_hi"), F.max("_s.x").alias("_x"))
    v = F.col("_lo") + (F.col("_x") - F.floor("_x")) * (F.col("_hi") - F.col("_lo"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", v.alias("v")))), lambda s: s["v"]).alias("quantiles"))


def quantiles(df: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    """by, quantiles: exact quantiles of value at the shares, in their order, linear between the two rows around a position.

    Nulls do not count; a group without values has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return quantiles_of(running(counts, "_v", ["_n"], *by), "_v", "_n", shares, *by)
