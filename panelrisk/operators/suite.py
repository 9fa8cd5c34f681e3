"""All evaluation tables of one or several populations from one pass over the scored rows.

Rows are summed up by population and score once, with the running counts of events and others; every table follows
from these sums, so the scored rows are read once however many tables are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.operators import metrics, ordered
from panelrisk.sources.scratch import stored


def score_sums(df: DataFrame, *by: str) -> DataFrame:
    """by, pd, n, pos, neg, cum_n (from the lowest score on), cum_pos, cum_neg (from the highest on), all_n, all_pos, all_neg; written."""
    g = metrics.score_groups(df, *by).withColumns({"n": F.col("pos") + F.col("neg"), "all_n": F.col("all_pos") + F.col("all_neg")})
    return stored(g.withColumn("cum_n", F.col("all_n") - F.col("cum_pos") - F.col("cum_neg") + F.col("n")), "score-sums")


def _grouped(g: DataFrame, by: tuple[str, ...]):
    return g.groupBy(*by) if by else g.groupBy()


def point(g: DataFrame, *by: str) -> DataFrame:
    """metrics.point_metrics from score sums."""
    p, n, pos, neg = F.greatest(F.lit(metrics.CLIP), F.least(F.lit(1 - metrics.CLIP), F.col("pd"))), F.col("n"), F.col("pos"), F.col("neg")
    rows, expected = F.sum("n"), F.sum(n * F.col("pd"))
    return _grouped(g, by).agg(
        rows.alias("observations"), (F.sum("pos") / rows).alias("actual_rate"), (expected / rows).alias("mean_pd"), (F.sum("pos") / F.nullif(expected, F.lit(0.0))).alias("observed_expected"),
        (-F.sum(pos * F.log(p) + neg * F.log(1 - p)) / rows).alias("log_loss"), (F.sum(pos * (1 - F.col("pd")) ** 2 + neg * F.col("pd") ** 2) / rows).alias("brier"),
    )


def confusion(g: DataFrame, threshold: float, *by: str) -> DataFrame:
    """metrics.confusion from score sums."""
    hit = F.col("pd") >= threshold
    count = lambda when, c: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    return metrics._rates(_grouped(g, by).agg(count(hit, "pos").alias("tp"), count(hit, "neg").alias("fp"), count(~hit, "pos").alias("fn"), count(~hit, "neg").alias("tn")))


def threshold_grid(g: DataFrame, lo: float, hi: float, step: float, *by: str) -> DataFrame:
    """metrics.threshold_grid from score sums."""
    grid = metrics.thresholds(lo, hi, step)
    bins = g.groupBy(*by, metrics.reached(grid, step).alias("reached")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return metrics._of_grid(bins, grid, *by)


def deciles(g: DataFrame, parts: int = 10, *by: str) -> DataFrame:
    """metrics.deciles from score sums, for each population between its own quantiles."""
    edges = ordered.quantiles_of(g, "pd", "n", [k / parts for k in range(parts + 1)], *by).select(*by, F.array_distinct("quantiles").alias("edges"))
    at = F.greatest(F.lit(1), ordered.edges_below(F.col("edges"), F.col("pd"), parts + 1))
    own = (g.join(edges, list(by)) if by else g.crossJoin(F.broadcast(edges))).withColumn("decile", at)
    d = own.groupBy(*by, "decile").agg(F.sum("n").alias("n"), F.sum("pos").alias("events"), (F.sum(F.col("n") * F.col("pd")) / F.sum("n")).alias("mean_pd"), F.max("all_pos").alias("_events"), F.max("all_n").alias("_rows"), F.max(F.col("all_pos") - F.col("cum_pos") + F.col("pos")).alias("_up"))
    rate = F.col("events") / F.col("n")
    return d.select(*by, "decile", "n", "events", "mean_pd", rate.alias("event_rate"), (F.col("_up") / F.nullif("_events", F.lit(0))).alias("cum_event_share"), (rate / F.nullif(F.col("_events") / F.col("_rows"), F.lit(0.0))).alias("lift"))


def calibration_table(g: DataFrame, edges: list[float], *by: str) -> DataFrame:
    """metrics.calibration_table from score sums."""
    n = F.sum("n")
    t = metrics.binned(g, edges).groupBy(*by, "bin").agg(n.alias("n"), (F.sum(F.col("n") * F.col("pd")) / n).alias("mean_pd"), (F.sum("pos") / n).alias("event_rate"))
    return t.withColumn("gap", F.abs(F.col("event_rate") - F.col("mean_pd")))


def top_shares(g: DataFrame, shares: list[float], *by: str) -> DataFrame:
    """by, share, population, captured, capture_rate, precision, mean_pd, lift of the ceil(n * share) riskiest rows.

    Of a score that the cut goes through, events count in proportion to the rows taken, so that no order of tied rows matters.
    """
    cut = F.explode(F.array(*map(F.lit, shares))).alias("share")
    own = g.select(*by, "pd", "n", "pos", "all_n", "all_pos", (F.col("all_n") - F.col("cum_n")).alias("_before"), cut).withColumn("population", F.ceil(F.round(F.col("all_n") * F.col("share"), 9)))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("population") - F.col("_before")) / F.col("n")))
    t = own.where("_before < population").groupBy(*by, "share", "population").agg(F.sum(part * F.col("pos")).alias("captured"), (F.sum(part * F.col("n") * F.col("pd")) / F.sum(part * F.col("n"))).alias("mean_pd"), F.max("all_pos").alias("_events"), F.max("all_n").alias("_rows"))
    precision = F.col("captured") / F.col("population")
    return t.select(*by, "share", "population", "captured", (F.col("captured") / F.nullif("_events", F.lit(0))).alias("capture_rate"), precision.alias("precision"), "mean_pd", (precision / F.nullif(F.col("_events") / F.col("_rows"), F.lit(0.0))).alias("lift"))


def suite(df: DataFrame, *by: str, edges: list[float], grid: tuple[float, float, float], threshold: float, parts: int = 10, shares: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2)) -> dict[str, DataFrame]:
    """Tables of all populations (by): rank, point, confusion, thresholds, deciles, calibration, calibration_errors, top_shares, curve.

    df (label, pd) is read once. curve has a row for each score; the others are small.
    """
    return tables_of(score_sums(df, *by), *by, edges=edges, grid=grid, threshold=threshold, parts=parts, shares=shares)


def tables_of(g: DataFrame, *by: str, edges: list[float], grid: tuple[float, float, float], threshold: float, parts: int = 10, shares: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2)) -> dict[str, DataFrame]:
    """The tables of `suite` from score sums."""
    table = calibration_table(g, edges, *by)
    errors = _grouped(table, by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
    return {
        "rank": metrics.rank_of(g, *by), "point": point(g, *by), "confusion": confusion(g, threshold, *by), "thresholds": threshold_grid(g, *grid, *by), "deciles": deciles(g, parts, *by),
        "calibration": table, "calibration_errors": errors, "top_shares": top_shares(g, list(shares), *by), "curve": metrics.curve_of(g, *by),
    }


#: The column that tells the rows of a table of the suite apart, besides the populations.
ROWS = {"thresholds": "threshold", "deciles": "decile", "calibration": "bin", "top_shares": "share", "curve": "pd"}


def in_long_form(tables: dict[str, DataFrame], *by: str) -> DataFrame:
    """table, by, row (null where a population has one), metric, value of all tables."""
    out = None
    for name, t in tables.items():
        own = next((c for kind, c in ROWS.items() if name == kind or name.endswith(f"_{kind}")), None)
        row: Column = F.col(own).cast("double") if own else F.lit(None).cast("double")
        values = [c for c in t.columns if c not in by and c != own]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values])).alias("m")
        part = t.select(F.lit(name).alias("table"), *by, row.alias("row"), pairs).select("table", *by, "row", "m.metric", "m.value")
        out = part if out is None else out.unionByName(part)
    return out
