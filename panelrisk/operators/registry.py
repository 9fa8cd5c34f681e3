"""Versions of fitted pipelines. A manifest is written last, so a version that was cut off is never loaded."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.operators import ml

MANIFEST = "version string, algorithm string, saved_at string, numeric array<string>, categories array<string>, assembled array<string>, metadata string, config string"


def population(df: DataFrame, label: str = "label", period: str = "vintage") -> dict[str, float]:
    """What a model was trained on: rows, events, and the first and last period."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("events"), F.min(period).alias("first"), F.max(period).alias("last")).first()
    return {"rows": r["rows"], "events": r["events"], "first_period": r["first"], "last_period": r["last"]}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_version(model: PipelineModel, root: str, version: str, metadata: dict | None = None, config: dict | None = None) -> None:
    """The fitted pipeline, then one row on it: its inputs, its training populations and metrics (metadata), and how it was built (config).

    A version that is complete is not written again; what an interrupted save has left is.
    """
    from pyspark.sql import SparkSession as Session

    spark, path = Session.active(), f"{root}/{version}"
    if _exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"version {version} is there already")
    model.write().overwrite().save(f"{path}/model")
    inputs = ml.input_contract(model)
    row = (version, type(model.stages[-1]).__name__, datetime.now(timezone.utc).isoformat(timespec="seconds"), inputs["numeric"], inputs["categories"], inputs["assembled"], json.dumps(metadata or {}, sort_keys=True), json.dumps(config or {}, sort_keys=True))
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of complete versions."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []  # one folder for each version
    done = [f"{f}/manifest" for f in found if _exists(spark, f"{f}/manifest/_SUCCESS")]
    return spark.read.schema(MANIFEST).json(done) if done else spark.createDataFrame([], MANIFEST)


def load_version(spark: SparkSession, root: str, version: str | None = None, columns: list[str] | None = None) -> tuple[PipelineModel, dict]:
    """A complete version (the one saved last, if none is named) and its manifest with metadata and config; raises where it is not there, or `columns` lack an input."""
    rows = versions(spark, root)
    rows = rows.where(F.col("version") == version) if version else rows.orderBy(F.col("saved_at").desc(), F.col("version").desc())
    row = rows.first()
    if row is None:
        raise ValueError(f"there is no complete version {version or ''} at {root}")
    found = row.asDict() | {"metadata": json.loads(row["metadata"]), "config": json.loads(row["config"])}
    if columns is not None and (gone := [c for c in [*found["numeric"], *found["categories"]] if c not in columns]):
        raise ValueError(f"columns missing: {gone}")
    return PipelineModel.load(f"{root}/{row['version']}/model"), found
