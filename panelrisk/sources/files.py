"""Readers and writers of panel files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.functions.scalar import month_of_date
from panelrisk.sources.spec import TableSpec


def read_delimited(spark: SparkSession, path: str | list[str], spec: TableSpec, sep: str = "|") -> DataFrame:
    """Header-less files as text columns by position; _corrupt holds rows of another width. Large files are split by Spark."""
    return spark.read.schema(spec.raw_schema()).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").csv(path, sep=sep, header=False)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_macro(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """A CSV with header: period as month ordinal, features as doubles."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(month_of_date(F.col("period").try_cast("date")).alias("period"), *[F.col(c).try_cast("double").alias(c) for c in features])


def read_vintages(spark: SparkSession, path: str, vintages: list[int]) -> DataFrame:
    """Some vintages of a dataset that is partitioned by vintage; the others' files are not read."""
    return spark.read.parquet(path).where(F.col("vintage").isin(*vintages))


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("vintage",), mode: str = "overwrite") -> None:
    """Parquet, one directory for each value; files are balanced by size, and a large value is split over several."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def ingest(spark: SparkSession, source: str | list[str], spec: TableSpec, target: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Read, coerce and write all files of a table in one job; returns rows, unreadable rows and rows without a key."""
    raw = read_delimited(spark, source, spec)
    typed = raw.select(*[f.column(F.col(f.name)) for f in spec.fields], F.col("_corrupt").isNotNull().alias("_bad"))
    from pyspark.sql import Observation

    seen = Observation()
    no_key = F.lit(False)
    for k in spec.key:
        no_key = no_key | F.col(k).isNull()
    watched = typed.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_bad").alias("bad_width"), F.count_if(no_key).alias("no_key")).drop("_bad")
    (write_partitioned(watched, target, by) if by else watched.write.mode("overwrite").parquet(target))
    got = seen.get
    return spark.createDataFrame([(spec.name, got["rows"], got["bad_width"], got["no_key"])], "table string, rows long, bad_width long, no_key long")
