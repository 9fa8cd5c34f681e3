"""Staged ingest of raw files: typed, checked, bad rows set apart, and published by rename only if the checks hold."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.sources import files
from panelrisk.sources.spec import TableSpec

#: The vintage and quarter in the name of a file or of its folder, as in performance_1999Q3.txt.
PERIOD = r"(\d{4})Q([1-4])[^/]*(?:/[^/]*)?$"


class IngestError(ValueError):
    """What kept files from being published; the target is as it was."""


@dataclass(frozen=True)
class Limits:
    """Share of a file's rows that may be set apart, and whether every file must have rows."""

    bad_share: float = 0.0
    empty_files: bool = False


def _moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; what was at the target goes when the new one is there."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    old, new, aside = Path(target), Path(source), Path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(old)
    fs.mkdirs(old.getParent())
    if had and not fs.rename(old, aside):
        raise IngestError(f"{target} cannot be moved aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise IngestError(f"{source} cannot be moved to {target}")
    if had:
        fs.delete(aside, True)


def _gone(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def typed(spark: SparkSession, source: str | list[str], spec: TableSpec) -> DataFrame:
    """Typed rows of raw files with vintage, quarter (of the file name) and reason: why a row is set apart, null for good rows."""
    raw = files.read_delimited(spark, source, spec)
    name = F.col("_metadata.file_path")
    part = lambda k: F.nullif(F.regexp_extract(name, PERIOD, k), F.lit("")).cast("int")
    no_key: Column = F.lit(False)
    for k in spec.key:
        value = next(f for f in spec.fields if f.name == k).column(F.col(k))
        no_key = no_key | value.isNull() | (F.trim(value.cast("string")) == "")
    reason = F.when(F.col("_corrupt").isNotNull(), "width").when(part(1).isNull(), "file name").when(no_key, "key")
    return raw.select(*[f.column(F.col(f.name)) for f in spec.fields], F.col("_corrupt").alias("line"), part(1).alias("vintage"), part(2).alias("quarter"), reason.alias("reason"))


def repeated_keys(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The keys that more than one row has."""
    return df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def staged_ingest(spark: SparkSession, source: str | list[str], spec: TableSpec, target: str, quarantine: str, limits: Limits = Limits()) -> DataFrame:
    """vintage, quarter, rows, bad_rows of what was published at target, partitioned by vintage and quarter.

    One job reads, types and writes good and bad rows to a staging folder beside the target. On the staged rows: no key twice over all files, no file
    without good rows, no more than the given share of bad rows in a file. If all holds, bad rows are moved to `quarantine` and the
    staged table to the target by rename; else IngestError says what did not, both stay as they were, and the staging folder goes.
    """
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        rows = typed(spark, source, spec).withColumn("good", F.col("reason").isNull())
        rows.hint("rebalance", "good", "vintage", "quarter").write.partitionBy("good", "vintage", "quarter").parquet(staging)
        staged = spark.read.schema(rows.schema).parquet(staging)
        # keys of one (vintage, quarter) can be repeated in another: the whole table is checked
        counts = staged.groupBy("vintage", "quarter").agg(F.count_if("good").alias("rows"), F.count_if(~F.col("good")).alias("bad_rows"))
        table = counts.orderBy("vintage", "quarter").collect()  # one row for each file period
        wrong = [] if table or limits.empty_files else ["there are no rows"]
        for r in table:
            what = f"{r['vintage']}Q{r['quarter']}"
            if not r["rows"] and not limits.empty_files:
                wrong.append(f"{what} has no good rows")
            if r["bad_rows"] > limits.bad_share * (r["rows"] + r["bad_rows"]):
                wrong.append(f"{what} has {r['bad_rows']} bad rows of {r['rows'] + r['bad_rows']}")
        twice = repeated_keys(staged.where("good"), spec).agg(F.count(F.lit(1))).first()[0]
        if twice:
            wrong.append(f"{twice} keys occur more than once")
        if wrong:
            raise IngestError("; ".join(wrong))
        if any(r["bad_rows"] for r in table):
            staged.where("NOT good").drop("good").write.mode("append").partitionBy("vintage", "quarter").parquet(quarantine)
        if any(r["rows"] for r in table):
            _moved(spark, f"{staging}/good=true", target)
        return spark.createDataFrame([tuple(r) for r in table], "vintage int, quarter int, rows long, bad_rows long")
    finally:
        _gone(spark, staging)


def read_ingested(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """A published table, without the columns that only bad rows fill: in good ones they hold nulls, which take no space."""
    return spark.read.parquet(path).select(*[f.name for f in spec.fields], "vintage", "quarter")
