"""Monthly files as a stream: the batch coercion on files as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from panelrisk.sources.spec import TableSpec


def ingest_stream(spark: SparkSession, source: str, spec: TableSpec, target: str, checkpoint: str, sep: str = "|") -> StreamingQuery:
    """Coerce every new delimited file of a folder and append it to a Parquet table; ends when all there are files are read."""
    raw = spark.readStream.schema(spec.raw_schema()).option("columnNameOfCorruptRecord", "_corrupt").csv(source, sep=sep, header=False)
    return spec.canonical(raw).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
