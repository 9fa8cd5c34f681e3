"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.llm.store import own_columns, private, written

#: Rows of the table of sources up to which it is broadcast (some 100 bytes a row); beyond it, sources join by a shuffle.
BROADCAST_SOURCES = 20_000
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of runs of anything but space and \\t \\n \\v \\f \\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone; without id, on the seed and the text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, target, rate: one row for each source of docs (columns source and size).

    Sources in code point order, null last, weigh `weights` again and again, and share 100% of all sizes. A
    target stops at `most` times its source's size; the excess goes to the others by weight until none is above.
    That fixed point is the level at which the targets min(most * size, level * weight) add up to the total:
    sources in order of most * size / weight are held until what is left over weight suffices. Sums over sources
    see one row for each source. A source without words has target 0 and rate 0.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cap = F.lit(most) * F.col("source_size")
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("double")).withColumn("cap", cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    heavy = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", left / heavy)
    # the level rises along the sources that are held and falls behind them
    target = F.least(F.col("cap"), F.max("level").over(whole) * F.col("weight"))
    s = s.withColumn("target", target)
    return s.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def _taken(docs: DataFrame, weights: tuple[int, ...], most: float, seed: int) -> tuple[DataFrame, str]:
    """docs with a struct of size, source_size, target, rate and copies, and the struct's name, which docs does not have."""
    name = private(docs, "_mix")
    sized = docs.withColumn(name, word_count(F.col("text").cast("string")))
    targets = written(source_targets(sized.select("source", F.col(name).alias("size")), weights, most), "sources")
    few = targets.count() <= BROADCAST_SOURCES
    own = private(sized, "_target")
    packed = targets.select(F.struct("source", "source_size", "target", "rate").alias(own))
    joined = sized.join(F.broadcast(packed) if few else packed, F.col("source").eqNullSafe(F.col(f"{own}.source")), "left")
    rate = F.col(f"{own}.rate")
    whole = F.floor(rate)
    extra = (uniform(seed, F.col("doc_id"), F.col("text").cast("string")) < rate - whole).cast("long")
    result = F.struct(F.col(name).alias("size"), F.col(f"{own}.source_size").alias("source_size"), F.col(f"{own}.target").alias("target"), rate.alias("rate"), (whole + extra).alias("copies"))
    return joined.select(*own_columns(docs), result.alias(name)), name


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """docs with size, source_size, target, rate and copies, the number of times that the mix takes the document.

    copies is floor(rate), plus one with probability equal to the fraction, drawn from a hash of seed and
    doc_id; rerun and partitioning change nothing. Rows with equal doc_id draw alike; rows without one draw by their text. Null
    sources are one source; null texts have size 0. Columns of docs with the names of the added ones are replaced.
    """
    added = ("size", "source_size", "target", "rate", "copies")
    own, name = _taken(docs, weights, most, seed)
    return own.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], *[F.col(f"{name}.{c}").alias(c) for c in added])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, seed: int = 7) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs, whatever their names."""
    own, name = _taken(docs, weights, most, seed)
    copy = private(own, "_copy")
    taken = own.where(F.col(f"{name}.copies") > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies").cast("int"))))
    return taken.select(*own_columns(docs))


def mix_digest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every document; taken: words that the mix takes of it."""
    m = mixed(docs.select("doc_id", "text", "source"), **how)
    return m.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS key, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('7:' || d.key), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
