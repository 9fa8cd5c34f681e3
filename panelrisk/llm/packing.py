"""Sharding: best-fit-decreasing packing of indivisible groups of equal texts into shards of like size.

Groups by decreasing size enter the bin with the tightest capacity left, found in a balanced tree. So many groups as a
corpus has do not fit one task, so they are packed twice by the same rule: each task packs its groups into units, small
against a shard, and one task packs the units and the larger groups, whose number is bounded by the number of shards and
tasks and not by the corpus. Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.llm.store import join_by_key, written

#: Units of a shard's mean size: each task leaves one unit less than half full at most, so `parts` units a shard become at most 3 * parts + tasks / shards items.
PARTS = 512
#: The capacity is searched to one in so many parts.
FINE = 1 << 16


def _height(t):
    return t[4] if t else 0


def _node(key, bins, left, right):
    return key, bins, left, right, 1 + max(_height(left), _height(right))


def _balanced(key, bins, left, right):
    if _height(left) > _height(right) + 1:
        k, b, ll, lr, _ = left
        if _height(ll) >= _height(lr):
            return _node(k, b, ll, _node(key, bins, lr, right))
        return _node(lr[0], lr[1], _node(k, b, ll, lr[2]), _node(key, bins, lr[3], right))
    if _height(right) > _height(left) + 1:
        k, b, rl, rr, _ = right
        if _height(rr) >= _height(rl):
            return _node(k, b, _node(key, bins, left, rl), rr)
        return _node(rl[0], rl[1], _node(key, bins, left, rl[2]), _node(k, b, rl[3], rr))
    return _node(key, bins, left, right)


class Capacities:
    """AVL tree of open bins by what is left in them; bins with as much left share a node."""

    def __init__(self):
        self.root = None

    def tightest(self, size: int) -> int | None:
        """The least capacity left that size fits in."""
        t, found = self.root, None
        while t:
            if t[0] < size:
                t = t[3]
            else:
                found, t = t[0], t[2]
        return found

    def add(self, key: int, own: int) -> None:
        def put(t):
            if t is None:
                return _node(key, [own], None, None)
            if key == t[0]:
                t[1].append(own)
                return t
            return _balanced(t[0], t[1], put(t[2]), t[3]) if key < t[0] else _balanced(t[0], t[1], t[2], put(t[3]))

        self.root = put(self.root)

    def take(self, key: int) -> int:
        """Take out the bin that has had key left for longest."""

        def least(t):
            return least(t[2]) if t[2] else t

        def drop(t, k):
            if k < t[0]:
                return _balanced(t[0], t[1], drop(t[2], k), t[3])
            if k > t[0]:
                return _balanced(t[0], t[1], t[2], drop(t[3], k))
            if not t[2] or not t[3]:
                return t[2] or t[3]
            after = least(t[3])
            return _balanced(after[0], after[1], t[2], drop(t[3], after[0]))

        t = self.root
        while t[0] != key:
            t = t[2] if key < t[0] else t[3]
        own = t[1].pop(0)
        if not t[1]:
            self.root = drop(self.root, key)
        return own


class Packer:
    """Best fit for sizes that are placed in decreasing order; what exceeds the capacity has a bin of its own."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.bins = capacity, Capacities(), 0

    def place(self, size: int) -> int:
        left = self.open.tightest(size)
        if left is None:
            own, left = self.bins, self.capacity
            self.bins += 1
        else:
            own = self.open.take(left)
        if left > size:
            self.open.add(left - size, own)
        return own


def packed(sizes: list[int], shards: int | None = None, capacity: int = 0) -> list[int]:
    """The bin of each of the sizes, which decrease: bins of the least capacity that `shards` of them suffice for, or of the capacity given.

    A capacity of the mean plus the largest size always suffices: another bin opens only if all hold more than the mean.
    """

    def bins(c):
        p = Packer(c)
        return [p.place(s) for s in sizes]

    if shards is None or not sizes:
        return bins(capacity)
    mean = -(-sum(sizes) // shards)
    low, high = max(mean, sizes[0]), mean + sizes[0]
    best = bins(low)
    if max(best) < shards:
        return best
    best = bins(high)
    while high - low > max(1, high // FINE):
        found = bins(tried := (low + high) // 2)
        if max(found) < shards:
            best, high = found, tried
        else:
            low = tried
    return best


def unit_size(total: int, shards: int | None, capacity: int, parts: int = PARTS) -> int:
    """Bytes of the units that tasks pack groups into: a part of a shard; whole shards where there are more than 64 * parts of them."""
    if shards is None:
        shards = max(1, -(-total // capacity))
        return max(1, min(capacity, capacity // max(1, min(parts, 64 * parts // shards))))
    return max(1, total // (shards * parts))


def _pack_task(unit: int):
    """Groups of a task, by decreasing size, into units; columns th, size, n, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = Packer(unit), TaskContext.get().partitionId() << 33
        for b in batches:
            units = np.fromiter((packer.place(s) for s in b.column(3).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(task + units)], names=["th", "size", "n", "bytes", "unit"])

    return run


def _pack_units(shards: int | None, capacity: int):
    """All units, by decreasing size, into shards; columns unit, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, sizes = [], []
        for b in batches:
            units.extend(b.column(0).to_pylist())
            sizes.extend(b.column(1).to_pylist())
        if units:
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(packed(sizes, shards, capacity), pa.int32())], names=["unit", "shard"])

    return run


def with_shards(rows: DataFrame, shards: int | None = 16, capacity: int = 0, parts: int = PARTS) -> DataFrame:
    """rows (a written table; columns size, th) with shard: groups of equal th and size stay together.

    shards: so many shards of the least capacity that best fit finds, numbered from 0; fewer where there are fewer
    groups. None: as few shards of `capacity` bytes as best fit finds; a group above it has a shard of its own.
    """
    spark = rows.sparkSession
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    unit = unit_size(total, shards, capacity, parts)
    groups = rows.groupBy("th", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("bytes", F.col("n") * F.col("size"))
    own = written(groups.sortWithinPartitions(F.col("bytes").desc(), "th", "size").mapInArrow(_pack_task(unit), "th long, size long, n long, bytes long, unit long"), "packed-groups")
    units = own.groupBy("unit").agg(F.sum("bytes").alias("bytes")).repartition(1).sortWithinPartitions(F.col("bytes").desc(), "unit")
    placed = written(units.mapInArrow(_pack_units(shards, capacity), "unit long, shard int"), "packed-units")
    table = own.join(F.broadcast(placed), "unit").select("th", "size", "n", "shard")
    return join_by_key(rows, table, ["th", "size"], "n", n_rows)


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with slot, the place of the row in its shard by `order`, from 0 on without gaps.

    Rows are dealt by ranges of shard and order, so that a shard is spread over tasks; slots count on from the ranges before.
    """
    dealt = rows.repartitionByRange("shard", *order).sortWithinPartitions("shard", *order)
    placed = written(dealt.withColumn("place", F.monotonically_increasing_id()), "slots").withColumn("task", F.shiftright("place", 33))
    ranges = placed.groupBy("task", "shard").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = ranges.select("task", "shard", (before - F.col("first")).alias("offset"))  # a row for each task and a few for shards that begin in it
    return placed.join(F.broadcast(offsets), ["task", "shard"]).withColumn("slot", F.col("place") + F.col("offset")).drop("place", "task", "offset")


def sharded(docs: DataFrame, shards: int | None = 16, capacity: int = 0, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; sizes of shards (UTF-8 bytes of texts, plus 1 for each) are near equal.

    Documents with equal texts are one group and share a shard; a null text is empty. Within a shard, slots follow doc_id
    (null first), then text hash; rows that are repeated have a slot each. Where one group exceeds the mean, its shard is larger by
    as much. Columns other than doc_id and text are not read. An empty table has no shard.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"))
    placed = with_slots(with_shards(written(rows, "sizes"), shards, capacity, parts), ["doc_id", "th", "size"])
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """sharded, with the law that holds (bytes: sizes near equal) and grown_shard, which is null under it."""
    return sharded(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
