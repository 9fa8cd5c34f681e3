"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = 2**63 - 1
#: Keys that hold a larger part of all rows than one in so many are joined by broadcast: at most so many keys.
HOT_PARTS = 1024
#: Names the temporary folder of a session that has no spark.checkpoint.dir.
OWN_DIR = "panelrisk.llm.dir"
#: Removes the shuffle files of an action when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a temporary folder if all runs in one process, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-checkpoints-", dir="/tmp")
        spark.conf.set(OWN_DIR, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it again: cuts the lineage, survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `written` has made, when nothing reads it any more."""
    files = df.inputFiles()
    if files:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def one_action(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go when their action ends; else those of all steps stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def bucket_count(spark: SparkSession, size: int, each: int) -> int:
    """Buckets for data of this size, none of which should hold more than `each`; two for each shuffle partition at least."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def private(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_columns(docs: DataFrame) -> list[Column]:
    """All columns of docs, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def keyed_rows(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the key of each row, as `keyed` makes it, and the names of its two columns, which docs does not have."""
    i, t = private(docs, "_id"), private(docs, "_th")
    return docs.withColumn(i, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(t, F.xxhash64(F.col("text").cast("string"))), i, t


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose key is not in gone (id, th), with their columns as they are, whatever their names."""
    own, i, t = keyed_rows(docs)
    return own.join(gone.select(F.col("id").alias(i), F.col("th").alias(t)).distinct(), [i, t], "left_anti").select(*own_columns(docs))


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Inner join of rows to the one row that table has for each key; column n of table: the rows that hold the key, total: all rows.

    Keys that hold more than one in HOT_PARTS of all rows, HOT_PARTS at most, are broadcast, so that no key meets
    in a task more than that part of the rows. Both inputs are read twice: pass written tables. n is left out of the result.
    """
    hot = table.where(F.col(n) * HOT_PARTS > total).drop(n)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(n) * HOT_PARTS <= total).drop(n), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key (id, th) that repeated rows share and that is never null.

    A null doc_id counts as the largest id. Columns other than doc_id and text are left out, so that
    no name can clash.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("th"),
    )


def in_fold(n: int):
    """crc32 of the id as text, modulo 5, equals n. False for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == n, F.lit(False))
