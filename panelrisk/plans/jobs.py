"""Batch jobs over paths: build the model input, train, evaluate, intervene."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.operators import calibrate, metrics, ml, ordered, panel, pit, splits, suite, validate
from panelrisk.sources import files


def build_model_input(perf: DataFrame, orig: DataFrame, target: str, ages=pit.AGES, horizon: int = pit.HORIZON) -> None:
    """Check keys, then join, build features and target, and write by vintage."""
    for df, keys in ((perf, ("loan_id", "period")), (orig, ("loan_id",))):
        if not validate.duplicate_keys(df, *keys).isEmpty():
            raise ValueError(f"{keys} is not unique")
    rows = pit.model_input(panel.master(panel.normalized(perf), panel.missing_indicators(panel.normalized(orig))), ages, horizon=horizon)
    files.write_partitioned(rows, target)


def train(spark: SparkSession, source: str, target: str, pipeline: Pipeline, vintages: dict[str, list[int]], label: str = "future_90dpd") -> PipelineModel:
    """Fit on the train vintages of a written model input and save the fitted pipeline with its input contract.

    Raises, and saves nothing, where the train vintages have no rows, a null label or one class only.
    """
    df = splits.yearly(spark.read.parquet(source).withColumn("label", F.col(label).cast("double")), vintages["train"], vintages["test"], vintages["oot"])
    model = ml.train(pipeline, df.where("split = 'train'"))
    ml.save_model(model, target)
    return model


def evaluate(scored: DataFrame, edges: list[float], threshold_step: float = 0.01, fit: str = "test") -> dict[str, DataFrame]:
    """scored: split, label, pd. All tables of the suite by split, of raw and of calibrated scores (raw_<table>, calibrated_<table>), and threshold.

    Beta calibration is fitted on the rows of split `fit`, and the threshold with the best F1 of their calibrated scores is used for both. scored
    is read for the fit and once for each suite.
    """
    calibrated = calibrate.logistic_calibration(scored.where(F.col("split") == fit), scored, "beta").withColumn("pd", F.col("calibrated")).select("split", "label", "pd")
    grid = (threshold_step, 0.99, threshold_step)
    sums = suite.score_sums(calibrated, "split")
    best = metrics.best_threshold(suite.threshold_grid(sums.where(F.col("split") == fit), *grid))
    at = best.first()["threshold"]
    named = lambda kind, tables: {f"{kind}_{name}": t for name, t in tables.items()}
    how = {"edges": edges, "grid": grid, "threshold": at}
    return named("raw", suite.suite(scored, "split", **how)) | named("calibrated", suite.tables_of(sums, "split", **how)) | {"threshold": best}


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Small result tables in long form as JSON lines (table, split, row, metric, value), and each curve, a row for each score, as Parquet beside them."""
    by = {name: [c for c in ("split",) if c in t.columns] for name, t in tables.items()}
    curves = [name for name in tables if name.endswith("curve")]
    small = None
    for name, t in tables.items():
        if name not in curves:
            part = suite.in_long_form({name: t}, *by[name])
            part = part if by[name] else part.withColumn("split", F.lit(None).cast("string"))
            small = part if small is None else small.unionByName(part)
    if small is not None:
        small.coalesce(1).write.mode("overwrite").json(f"{path}/tables")
    for name in curves:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


# The names of the columns and the two bands that users of the flags read.
def intervene(scored: DataFrame, threshold: float) -> DataFrame:
    """scored with intervention_flag, _band and _rank by period, for all vintages in one job; unflagged rows are not ranked.

    Ranks run over ranges of period, pd, balance and id, so that a period is not held by one task. scored is read twice.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    hit = F.col("pd") >= threshold
    flagged = ordered.positions(scored.where(hit), [F.col("pd").desc(), F.col("current_actual_upb").desc(), "loan_id"], "period")
    rank = flagged.withColumn("intervention_rank", F.col("position").cast("int")).drop("position", "n_rows")
    marked = lambda df, flag, band: df.withColumns({"intervention_flag": F.lit(flag), "intervention_band": F.lit(band)})
    others = scored.where(~hit | F.col("pd").isNull()).withColumn("intervention_rank", F.lit(None).cast("int"))
    return marked(rank, 1, "FLAG").unionByName(marked(others, 0, "NO_FLAG"))
