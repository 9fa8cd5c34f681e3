"""Isotonic calibration by ranges of scores.

Rows are counted by score; each range of scores pools its adjacent violators, and one task pools the blocks that are left,
which come in order: pooling does not depend on the order in which it is done. Of n rows with labels 0 and 1 some n ** (2 / 3) blocks
are left, not n, and none of them pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.operators import ordered
from panelrisk.sources.scratch import stored

KIND = "lo double, hi double, n double, s double"


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (bounds, weight, sum) in the order of scores, adjacent ones pooled while their means do not rise."""
    lo, hi, n, s = [], [], [], []
    for b in batches:
        for l_, h, w, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
            while n and s[-1] * w >= t * n[-1]:
                l_, w, t = lo.pop(), w + n.pop(), t + s.pop()
                hi.pop()
            lo.append(l_)
            hi.append(h)
            n.append(w)
            s.append(t)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()) for x in (lo, hi, n, s)], names=["lo", "hi", "n", "s"])


def blocks(fit: DataFrame) -> DataFrame:
    """lo, hi, value: the bounds of each block of scores of fit (label, pd) and its monotone value; written. Rows without score or label do not count."""
    counts = fit.where("pd IS NOT NULL AND label IS NOT NULL").groupBy(F.col("pd").cast("double").alias("lo")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("s"))
    own = counts.select("lo", F.col("lo").alias("hi"), "n", "s").repartitionByRange("lo").sortWithinPartitions("lo").mapInArrow(_pool, KIND)
    left = own.repartition(1).sortWithinPartitions("lo").mapInArrow(_pool, KIND)
    return stored(left.select("lo", "hi", (F.col("s") / F.col("n")).alias("value")), "isotonic")


def interpolated(xs: DataFrame, points: DataFrame) -> DataFrame:
    """x, y of the different x of xs: linear between the points (x, y; different x) on either side, constant beyond the first and last.

    Both are dealt by ranges of x; a range learns the last point before it and the first behind it, one row for each range. Without points y is null.
    """
    both = xs.select(F.col("x").cast("double").alias("x"), F.lit(None).cast("double").alias("y")).where("x IS NOT NULL").unionByName(points.select("x", "y"))
    rows = ordered._dealt(both.groupBy("x").agg(F.max("y").alias("y")), ["x"])
    point = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    # both sides by a frame that grows: one that ends in UNBOUNDED FOLLOWING is read anew for each row
    upto = lambda *order: Window.partitionBy("_task").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumns({"_p": F.last(point, ignorenulls=True).over(upto("_at")), "_q": F.last(point, ignorenulls=True).over(upto(F.desc("_at")))})
    ranges = rows.groupBy("_task").agg(F.max(point).alias("_last"), F.min(point).alias("_first"))
    others = lambda *order: Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(F.col("_task"), F.max("_last").over(others("_task")).alias("_before"), F.min("_first").over(others(F.desc("_task"))).alias("_behind"))
    met = near.join(F.broadcast(carried), "_task").select("x", F.coalesce("_p", "_before").alias("p"), F.coalesce("_q", "_behind").alias("q"))
    p, q = F.coalesce("p", "q"), F.coalesce("q", "p")
    share = F.when(q["x"] > p["x"], (F.greatest(F.least(F.col("x"), q["x"]), p["x"]) - p["x"]) / (q["x"] - p["x"])).otherwise(F.lit(0.0))
    return met.select("x", (p["y"] + share * (q["y"] - p["y"])).alias("y"))


def isotonic(fit: DataFrame, df: DataFrame) -> DataFrame:
    """df with calibrated: the monotone value of its score's block in fit, linear between blocks, constant beyond them. df is read twice."""
    own = blocks(fit)
    ends = F.explode(F.array_distinct(F.array("lo", "hi")))
    points = own.select("value", ends.alias("x")).select("x", F.col("value").alias("y"))
    values = interpolated(df.select(F.col("pd").alias("x")).distinct(), points)
    return df.join(values.select(F.col("x").alias("_x"), F.col("y").alias("calibrated")), F.col("pd") == F.col("_x"), "left").drop("_x")
