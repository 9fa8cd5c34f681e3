"""Evaluation of scores on any frame with columns label (0, 1) and pd; tied scores are one group.

Rows are summed up by score, and sums along the scores run over ranges of scores (see ordered), so that no task holds all of them.
Functions that read df more than once say so: give them a table that is written or cached; `suite` makes all tables from one pass.
Every function takes group keys, for metrics by vintage or period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.operators import ordered

CLIP = 1e-15


def score_groups(df: DataFrame, *by: str) -> DataFrame:
    """by, pd, pos, neg, cum_pos, cum_neg (from the highest score on) and all_pos, all_neg."""
    g = df.groupBy(*by, "pd").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    return ordered.running(g, "pd", ["pos", "neg"], *by, descending=True)


def rank_metrics(df: DataFrame, *by: str) -> DataFrame:
    """roc_auc, average precision (step sum) and KS; null where a class is missing."""
    return rank_of(score_groups(df, *by), *by)


def rank_of(g: DataFrame, *by: str) -> DataFrame:
    """rank_metrics from score_groups."""
    better = F.col("cum_pos") - F.col("pos")
    area = F.sum(F.col("neg") * (better + F.col("pos") / 2)) / (F.max("all_pos") * F.max("all_neg"))
    precision = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))) / F.max("all_pos")
    gap = F.max(F.abs(F.col("cum_pos") / F.col("all_pos") - F.col("cum_neg") / F.col("all_neg")))
    two = g.withColumns({"all_pos": F.nullif("all_pos", F.lit(0)), "all_neg": F.nullif("all_neg", F.lit(0))})
    own = two.groupBy(*by) if by else two.groupBy()
    return own.agg(area.alias("roc_auc"), precision.alias("average_precision"), gap.alias("ks"))


def curve(df: DataFrame, *by: str) -> DataFrame:
    """One row for each score: tpr, fpr and their gap (points of the ROC and KS curves)."""
    return curve_of(score_groups(df, *by), *by)


def curve_of(g: DataFrame, *by: str) -> DataFrame:
    tpr, fpr = F.col("cum_pos") / F.nullif("all_pos", F.lit(0)), F.col("cum_neg") / F.nullif("all_neg", F.lit(0))
    return g.select(*by, "pd", tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("gap"))


def _confusion(threshold: Column) -> dict[str, Column]:
    hit, y = F.col("pd") >= threshold, F.col("label") == 1
    return {"tp": F.count_if(hit & y), "fp": F.count_if(hit & ~y), "fn": F.count_if(~hit & y), "tn": F.count_if(~hit & ~y)}


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return df.withColumns({"accuracy": safe(tp + tn, tp + fp + fn + tn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn), "specificity": safe(tn, tn + fp)})


def confusion(df: DataFrame, threshold: float, *by: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1, specificity at a threshold."""
    own = df.groupBy(*by) if by else df.groupBy()
    return _rates(own.agg(*[c.alias(k) for k, c in _confusion(F.lit(threshold)).items()]))


def point_metrics(df: DataFrame, *by: str) -> DataFrame:
    """observations, actual_rate, mean_pd, observed_expected, log_loss (clipped), brier."""
    p, y = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("pd"))), F.col("label")
    own = df.groupBy(*by) if by else df.groupBy()
    return own.agg(
        F.count(F.lit(1)).alias("observations"), F.avg("label").alias("actual_rate"), F.avg("pd").alias("mean_pd"), (F.sum("label") / F.nullif(F.sum("pd"), F.lit(0.0))).alias("observed_expected"),
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg((F.col("pd") - y) ** 2).alias("brier"),
    )


def binned(df: DataFrame, edges: list[float]) -> DataFrame:
    """df with bin: 1 for [edge0, edge1], k for (edge k-1, edge k]; rows outside are left out."""
    b = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        b = F.when(F.col("pd") <= edges[k], k).otherwise(b)
    return df.where((F.col("pd") >= edges[0]) & (F.col("pd") <= edges[-1])).withColumn("bin", b)


def calibration_table(df: DataFrame, edges: list[float], *by: str) -> DataFrame:
    """by, bin, n, mean_pd, event_rate, gap over right-closed bins."""
    out = binned(df, edges).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("pd").alias("mean_pd"), F.avg("label").alias("event_rate"))
    return out.withColumn("gap", F.abs(F.col("event_rate") - F.col("mean_pd")))


def calibration_errors(table: DataFrame) -> DataFrame:
    """ece and mce of a calibration table."""
    return table.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def deciles(df: DataFrame, n: int = 10, from_highest: bool = False) -> DataFrame:
    """Right-closed bins at exact quantiles of pd (equal edges once), with shares and lift; df is read twice.

    Bins are numbered, and shares add up, from the lowest risk on, or from the highest. The edges are one row of n + 1 values and
    join by broadcast.
    """
    edges = ordered.quantiles(df, "pd", [k / n for k in range(n + 1)]).select(F.array_distinct("quantiles").alias("edges"))
    at = F.greatest(F.lit(1), ordered.edges_below(F.col("edges"), F.col("pd"), n + 1))
    own = df.crossJoin(F.broadcast(edges)).withColumn("decile", (F.greatest(F.size("edges"), F.lit(2)) - at if from_highest else at).cast("int"))
    g = own.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("events"), F.avg("pd").alias("mean_pd"))
    whole = Window.partitionBy(F.lit(1))
    up = whole.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.col("events") / F.col("n")
    return g.select("decile", "n", "events", "mean_pd", rate.alias("event_rate"), (F.sum("events").over(up) / F.sum("events").over(whole)).alias("cum_event_share"), (rate / (F.sum("events").over(whole) / F.sum("n").over(whole))).alias("lift"))


def positions(df: DataFrame, *key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with position (from 1, the highest pd first, ties by key) and n_rows of its group; neither a group nor a score is held by one task."""
    return ordered.positions(df, [F.col("pd").desc(), *key], *by)


def risk_tiles(df: DataFrame, n: int, *key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, tile, n, events, mean_pd of n parts of equal size, the highest risk first; ties by key."""
    own = positions(df, *key, by=by)
    at, size, extra = F.col("position") - 1, F.floor(F.col("n_rows") / n), F.col("n_rows") % n
    large = extra * (size + 1)
    tile = F.when(at < large, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - large) / F.greatest(size, F.lit(1)))) + 1
    return own.withColumn("tile", tile.cast("int")).groupBy(*by, "tile").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("events"), F.avg("pd").alias("mean_pd"))


def top_share(df: DataFrame, shares: list[float], *key: str) -> DataFrame:
    """share, population, captured, capture_rate, precision, mean_pd, lift of the ceil(n * share) riskiest rows; ties by key."""
    own = positions(df, *key)
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("all_events"))
    cut = total.select("rows", "all_events", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("population", F.ceil(F.round(F.col("rows") * F.col("share"), 9)))
    g = own.crossJoin(F.broadcast(cut)).where("position <= population").groupBy("share", "population", "rows", "all_events").agg(F.sum("label").cast("long").alias("captured"), F.avg("pd").alias("mean_pd"))
    precision = F.col("captured") / F.col("population")
    return g.select("share", "population", "captured", (F.col("captured") / F.col("all_events")).alias("capture_rate"), precision.alias("precision"), "mean_pd", (precision / (F.col("all_events") / F.col("rows"))).alias("lift"))


def thresholds(lo: float, hi: float, step: float) -> list[float]:
    """lo, lo + step, ... below hi; raises where they do not lie between 0 and 1."""
    if not (0 < lo < 1 and lo < hi <= 1 and step > 0):
        raise ValueError(f"thresholds from {lo} to {hi} by {step} do not lie between 0 and 1")
    return [round(lo + k * step, 10) for k in range(int(-(-(hi - lo - 1e-12) // step)))]


def reached(grid: list[float], step: float) -> Column:
    """How many thresholds of an even grid pd reaches: by division, and one comparison on either side for what it rounds."""
    k = F.least(F.lit(len(grid) - 1), F.greatest(F.lit(-1), F.floor((F.col("pd") - grid[0]) / step))).cast("int")
    at = lambda i: F.round(F.lit(grid[0]) + i * F.lit(step), 10)
    here = F.when((k + 1 < len(grid)) & (at(k + 1) <= F.col("pd")), k + 2)
    return here.when((k >= 0) & (at(k) > F.col("pd")), k).otherwise(k + 1)


def _of_grid(bins: DataFrame, grid: list[float], *by: str) -> DataFrame:
    """The threshold table of bins (by, reached, pos, neg): sums of one row for each number of thresholds reached."""
    g = bins.select(*by, "reached", "pos", "neg", F.posexplode(F.array(*map(F.lit, grid))).alias("k", "threshold"))
    hit = F.col("reached") > F.col("k")
    count = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    counted = g.groupBy(*by, "threshold").agg(count(hit, "pos").alias("tp"), count(hit, "neg").alias("fp"), count(~hit, "pos").alias("fn"), count(~hit, "neg").alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    more = {"flagged": tp + fp, "flagged_share": safe(tp + fp, tp + fp + fn + tn), "event_capture_rate": F.col("recall"), "false_negative_rate": safe(fn, tp + fn), "false_positive_rate": safe(fp, fp + tn)}
    return _rates(counted).withColumns(more)


def threshold_grid(df: DataFrame, lo: float, hi: float, step: float, *by: str) -> DataFrame:
    """One row for each threshold in lo, lo + step, ... below hi: flagged rows and their share, confusion counts, rates, and rates of errors.

    Rows are summed up by the number of thresholds that they reach; only these sums, one row for each, meet the grid.
    """
    grid = thresholds(lo, hi, step)
    bins = df.groupBy(*by, reached(grid, step).alias("reached")).agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    return _of_grid(bins, grid, *by)


def best_threshold(grid: DataFrame, metric: str = "f1") -> DataFrame:
    """The row with the best metric; ties by precision, recall, then the lowest threshold."""
    return grid.orderBy(F.col(metric).desc(), F.col("precision").desc(), F.col("recall").desc(), "threshold").limit(1)
