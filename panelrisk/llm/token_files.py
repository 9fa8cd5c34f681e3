"""Token-ID output: sorted ORC files with run-length encoded ids, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from panelrisk.llm.encode import default_tokenizer, encoder

FILE_SCHEMA = S.StructType([
    S.StructField("doc_id", S.LongType()), S.StructField("block", S.IntegerType()), S.StructField("block_start", S.LongType()),
    S.StructField("n_tokens", S.LongType()), S.StructField("ids", S.ArrayType(S.IntegerType())),
])


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, stripe_bytes: int = 64 << 20, index_stride: int = 1000) -> None:
    """Encode every whole text and write ORC files in ascending doc_id order.

    Texts are dealt by ranges of doc_id and sorted before they are encoded, so that ids are never shuffled; a
    range is a block and becomes one file. Ids are an integer column (run-length encoded in stripes), doc_id has
    row indexes every `index_stride` rows and a Bloom filter. block_start is the number of ids of earlier rows of the
    same block. A null text is empty and has the end id alone; null doc_ids come first; rows with equal doc_id
    stay separate rows, by text.
    """
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, counts, ids in own.rows(batch.column(1)):
                n = hi - lo
                offsets = np.zeros(n + 1, np.int64)
                np.cumsum(counts + 1, out=offsets[1:])
                out = np.full(offsets[-1], end_id, np.int32)
                keep = np.ones(offsets[-1], bool)
                keep[offsets[1:] - 1] = False
                out[keep] = ids
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.full(n, block, np.int32)), pa.array(start + offsets[:-1]), pa.array(counts + 1),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))],
                    names=FILE_SCHEMA.names,
                )
                start += int(offsets[-1])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, FILE_SCHEMA).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(index_stride)).option(
        "orc.stripe.size", str(stripe_bytes)).option("orc.compress", "ZSTD").orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of token files; with doc_ids only those, for which stripes are skipped by index and Bloom filter."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    return files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))


def block_offsets(files: DataFrame) -> DataFrame:
    """block, before: the ids of all earlier blocks. Gathers one row for each block."""
    totals = files.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    return totals.select("block", (F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of token files with start, the number of ids of all rows before them, for block and block_start."""
    return rows.join(block_offsets(files), "block").withColumn("start", F.col("before") + F.col("block_start")).drop("block", "before", "block_start")


def digests(files: DataFrame) -> DataFrame:
    """doc_id, block, block_start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            offsets, flat = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], names=["doc_id", "block", "block_start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(crc, "doc_id long, block int, block_start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, path: str, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of docs, read them back, and return doc_id, start, n_tokens, ids_crc32."""
    write_token_files(docs, path, tokenizer)
    files = read_token_files(docs.sparkSession, path)
    return with_starts(digests(files), files).select("doc_id", "start", "n_tokens", "ids_crc32")
