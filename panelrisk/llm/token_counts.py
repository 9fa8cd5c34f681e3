"""Token counts: an exact length histogram whose suffix sums answer totals, quantiles and truncated totals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.llm.encode import default_tokenizer, encoder


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text; a null text is empty and has none."""
    tokenizer = tokenizer or default_tokenizer()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            counts = [c for _, _, c, _ in own.rows(batch.column(1), with_ids=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lengths, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length L that occurs, with exact suffix sums.

    n_tokens (L), n_docs, tokens; docs_from and tokens_from count the documents of L tokens or more;
    truncated_total is the sum of min(length, L), that is the tokens left at a context limit of L; over_docs
    are cut at that limit; cum_share is the share of documents of at most L tokens (the quantile that L answers).
    Documents are summed up before anything is gathered: the running sums see one row for each length,
    of which there are at most sqrt(2 * all tokens). An empty table gives no rows.
    """
    h = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    w = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("n_tokens", "n_docs", "tokens", F.sum("n_docs").over(w).alias("docs_from"), F.sum("tokens").over(w).alias("tokens_from"))
    everything = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = h.withColumn("all_docs", F.max("docs_from").over(everything)).withColumn("all_tokens", F.max("tokens_from").over(everything))
    over = F.col("docs_from") - F.col("n_docs")
    return h.select(
        "n_tokens", "n_docs", "tokens", "docs_from", "tokens_from", over.alias("over_docs"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("cum_share"),
    )


def summary(histogram: DataFrame, limits: list[int], quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Totals, quantiles and the total left at each context limit, from the histogram alone."""
    left = [F.sum(F.least("n_tokens", F.lit(x)) * F.col("n_docs")).alias(f"left_at_{x}") for x in limits]
    at = [F.min(F.when(F.col("cum_share") >= q, F.col("n_tokens"))).alias(f"p{round(100 * q)}") for q in quantiles]
    return histogram.agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("tokens"), *at, *left)
