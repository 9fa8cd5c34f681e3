"""Conversation prefix trie: nodes of shared first turns, and totals over their subtrees by depth bands.

A node is a distinct sequence of first turns, known by two 64-bit exclusive-or sums of hashes of its turns, each of
which holds its place. Texts are hashed and counted where they are read and never shuffled. A node explodes only to its
ancestors in its own band of `height` depths, so a trie of any depth explodes by that factor at most; the roots of the
bands are a trie of a depth less by that factor, which is summed up in the same way, and their totals then go to the nodes of
the band above. There are as many rounds as the depth has digits in that base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.llm.mixing import word_count
from panelrisk.llm.store import join_by_key, written

HEIGHT = 16
#: Ids of conversations that end at one node are hashed in blocks of at most so many.
BLOCK = 10_000
KEY = ["depth", "p", "q"]


def _local_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among the rows of its conversation in this task (from 1), and whether the conversation is the task's first."""
    task, first, last, seen = TaskContext.get().partitionId(), None, None, 0
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        place = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        if last == ids[0]:
            place[: starts[1] if len(starts) > 1 else len(ids)] += seen
        first = ids[0] if first is None else first
        last, seen = ids[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *b.columns[2:], pa.array(place), pa.array(np.full(len(ids), task, np.int32)), pa.array(ids == first)], names=["conv_id", "role", "m", "words", "place", "task", "edge"]
        )


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, m (MD5 of the text), words, pos: turns in the order of turn (null first), then role and m; pos from 1.

    Turns are dealt by ranges of the whole order, so that a conversation of any length is spread over tasks; what a
    conversation has in earlier tasks is added, one row for each task at most.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("m"), word_count(text).alias("words"))
    order = ["conv_id", "turn", "role", "m"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = written(dealt.mapInArrow(_local_places, "conv_id long, role string, m binary, words long, place long, task int, edge boolean"), "turns")
    firsts = own.where("edge").select("task", "conv_id").distinct()  # one row for each task
    counts = own.join(F.broadcast(firsts.select("conv_id").distinct()), "conv_id").groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    carried = counts.select("conv_id", "task", before.alias("before")).where("before > 0")
    pos = F.col("place") + F.coalesce(F.col("before"), F.lit(0))
    return own.join(F.broadcast(carried), ["conv_id", "task"], "left").select("conv_id", "role", "m", "words", pos.alias("pos"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations (conv_id, role, m, words, depth), and conv_id of all, with those that have no turn.

    A conversation c takes the first h turns of the conversation c - c % every, where h is crc32(c) % most, and its
    own turns after its first h. turns is read several times: pass a written table.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % every
    ids = turns.where("pos = 1").select("conv_id", base.alias("base"), h.alias("h"))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    taken = ids.where("h > 0").join(heads, "base").where("pos <= h").select("conv_id", "role", "m", "words", F.col("pos").alias("depth"))
    there = heads.groupBy("base").agg(F.max("pos").alias("there"))
    # turns move up where the other conversation has fewer than h
    moved = ids.where("h > 0").join(there, "base", "left").select("conv_id", (F.least("h", F.coalesce("there", F.lit(0))) - F.col("h")).alias("shift")).where("shift <> 0")
    own = turns.where(F.col("pos") > h).join(moved, "conv_id", "left").select("conv_id", "role", "m", "words", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("depth"))
    return taken.unionByName(own), ids.select("conv_id")


def prefixes(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """rows (conv_id, role, m, words, depth) with p, q, the key of the first `depth` turns, and pp, pq, that of one turn less.

    Windows see the turns of a conversation in one band; the sums of earlier bands, one row each, are added.
    """
    lanes = [F.xxhash64("depth", "role", "m"), F.xxhash64(F.lit(7), "depth", "m", "role")]
    own = rows.select("conv_id", "depth", "words", F.floor((F.col("depth") - 1) / height).alias("band"), lanes[0].alias("a"), lanes[1].alias("b"))
    bands = own.groupBy("conv_id", "band").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = bands.select("conv_id", "band", *[F.bit_xor(s).over(earlier).alias(t) for s, t in (("sa", "ca"), ("sb", "cb"))]).where("band > 0")
    inside = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumns({"p": F.bit_xor("a").over(inside), "q": F.bit_xor("b").over(inside)}).join(carried, ["conv_id", "band"], "left")
    p, q = (F.col(c).bitwiseXOR(F.coalesce(F.col(k), F.lit(0))) for c, k in (("p", "ca"), ("q", "cb")))
    return summed.select("conv_id", "depth", "words", p.alias("p"), q.alias("q"), p.bitwiseXOR(F.col("a")).alias("pp"), q.bitwiseXOR(F.col("b")).alias("pq"))


def _to_ancestors(values: DataFrame, rows: DataFrame, step: int, height: int, sums: list[str], across: bool = False) -> DataFrame:
    """Sums over values (conv_id, depth, sums; depths are multiples of step) for each node with a multiple of step as its depth.

    A value goes to the nodes on its path in its own band of height * step depths, itself among them; across: to
    those in the band above. The conversation that stands for a node holds its whole path, so both sides meet by conversation and band.
    """
    wide = height * step
    if across:
        values = values.where(F.col("depth") >= wide)
    band = F.floor(F.col("depth") / wide).cast("long")
    left = values.select("conv_id", (band - 1 if across else band).alias("band"), F.col("depth").alias("_d"), *sums)
    path = rows.where(F.col("depth") % step == 0).select("conv_id", band.alias("band"), "depth", "p", "q")
    met = left.join(path, ["conv_id", "band"])
    return (met if across else met.where("depth <= _d")).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in sums])


def subtree_totals(nodes: DataFrame, rows: DataFrame, deepest: int, sums: list[str], height: int = HEIGHT, step: int = 1) -> DataFrame:
    """depth, p, q and the sums over the subtree of each node whose depth is a multiple of step.

    nodes: conv_id (a member), depth, p, q and sums, a row each; rows: the path of every conversation, the root included. Both are written tables.
    """
    inside = _to_ancestors(nodes, rows, step, height, sums)
    if deepest < height * step:
        return inside
    inside = written(inside, "trie-bands")
    roots = nodes.select("conv_id", *KEY).join(inside, KEY).where(F.col("depth") % (height * step) == 0)
    whole = subtree_totals(written(roots, "trie-roots"), rows, deepest, sums, height, height * step)
    done = written(nodes.select("conv_id", *KEY).join(whole, KEY), "trie-totals")
    below = _to_ancestors(done, rows, step, height, sums, across=True)
    return inside.unionByName(below).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in sums])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node, as comma-joined ids; columns depth, p, q, conv_id."""
    names = [*KEY, "first", "ids"]
    for b in batches:
        key = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        ids, n = b.column(3).to_pylist(), b.num_rows
        cut = np.ones(n, bool)
        cut[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])
        starts = np.flatnonzero(cut)
        if n > BLOCK:
            starts = np.union1d(starts, np.arange(0, n, BLOCK))
        ends = np.append(starts[1:], n).tolist()
        texts = [",".join(map(str, ids[i:j])) for i, j in zip(starts.tolist(), ends, strict=True)]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[starts]) for k in key], pa.array([ids[i] for i in starts.tolist()], pa.int64()), pa.array(texts)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the blocks of each node, which come one after the other."""
    state, last = None, None

    def out(done):
        return pa.RecordBatch.from_arrays([*[pa.array([k[i] for k, _ in done], pa.int64()) for i in range(3)], pa.array([h for _, h in done], pa.string())], names=[*KEY, "sha"])

    for b in batches:
        done = []
        for d, p, q, ids in zip(*[b.column(k).to_pylist() for k in (0, 1, 2, 4)], strict=True):
            if (d, p, q) == last:
                state.update(b"," + ids.encode())
            else:
                if state:
                    done.append((last, state.hexdigest()))
                state, last = hashlib.sha256(ids.encode()), (d, p, q)
        yield out(done)
    if state:
        yield out([(last, state.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, p, q, sha: SHA-256 of the ids of the conversations that end at a node, ascending and comma-joined.

    Ids are sorted by ranges of node and id, so that a node of very many is spread over tasks, and joined in blocks; of such a node,
    one task then hashes the blocks as they come: a digest of one text can't be split further, but holds no more than a block.
    """
    dealt = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    blocks = dealt.select(*KEY, "conv_id").mapInArrow(_blocks, "depth long, p long, q long, first long, ids string")
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, p long, q long, sha string")


def trie(conversations: DataFrame, every: int = 20, most: int = 4, height: int = HEIGHT) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; turns that share a number are ordered by role and MD5 of the text; rows without a conv_id belong to
    no conversation. c - c % every takes the sign of c, as in SQL. Repeated rows are turns of their own. Other columns are not read.
    An empty table has no node, not even a root.
    """
    turns = written(placed_turns(conversations), "placed-turns")
    rows, ids = rebuilt(turns, every, most)
    own = prefixes(written(rows, "rebuilt"), height)
    root = ids.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "words", "p", "q", "pp", "pq")])
    path = written(own.unionByName(root), "prefixes")
    nodes = path.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("words").alias("words"), F.min("pp").alias("pp"), F.min("pq").alias("pq"))
    nodes = written(nodes, "nodes")
    up: list[Column] = [(F.col("depth") - 1).alias("depth"), F.col("pp").alias("p"), F.col("pq").alias("q")]
    children = nodes.where("depth > 0").select(*up).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    valued = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = written(valued.withColumns({"n_leaves": leaf, "saved_tokens": saved}), "valued-nodes")
    n, deepest = valued.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    sums = ["n_leaves", "saved_tokens"]
    totals = subtree_totals(valued.select("conv_id", *KEY, *sums), path, deepest, sums, height)
    length = path.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("k"))
    ends = end_digests(length.select("k.*", "conv_id"))
    below = valued.where("depth > 0").select("conv_id", F.col("depth").alias("_depth"), F.col("p").alias("_p"), F.col("q").alias("_q"), *up)
    parents = valued.select(*KEY, F.col("conv_id").alias("parent_conv_id"), "n_children")
    parent = join_by_key(below, parents, KEY, "n_children", n).select(F.col("_depth").alias("depth"), F.col("_p").alias("p"), F.col("_q").alias("q"), "parent_conv_id")
    out = valued.drop(*sums).join(totals, KEY).join(parent, KEY, "left").join(ends, KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, md5(coalesce(text, '')) AS m, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, m) AS pos FROM t),
len AS (SELECT conv_id, max(pos) AS n FROM o GROUP BY conv_id),
ids AS (
  SELECT conv_id AS c, conv_id - conv_id % 20 AS base,
    xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM len),
b AS (
  SELECT c, o.role, o.m, o.words, o.pos AS depth FROM ids JOIN o ON o.conv_id = ids.base AND o.pos <= h
  UNION ALL
  SELECT c, o.role, o.m, o.words, o.pos - h + least(h, coalesce(len.n, 0)) FROM ids JOIN o ON o.conv_id = c AND o.pos > h LEFT JOIN len ON len.conv_id = ids.base),
p AS (
  SELECT c, depth, words, string_agg(md5(role) || m, '') OVER (PARTITION BY c ORDER BY depth) AS k FROM b
  UNION ALL
  SELECT c, 0, 0, '' FROM ids),
n AS (SELECT depth, k, count(*) AS n_convs, min(c) AS conv_id, min(words) AS words FROM p GROUP BY depth, k),
ch AS (SELECT depth - 1 AS depth, left(k, 64 * (depth - 1)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (depth, k)),
s AS (
  SELECT e AS depth, left(k, 64 * e) AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT v.*, unnest(range(depth + 1)) AS e FROM v) GROUP BY 1, 2),
l AS (SELECT c, max(k) AS k FROM p GROUP BY c),
d AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM l GROUP BY k)
SELECT v.conv_id, v.depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(d.sha, sha256('')) AS ends_sha256
FROM v JOIN s USING (depth, k) LEFT JOIN n AS up ON up.depth = v.depth - 1 AND up.k = left(v.k, 64 * (v.depth - 1)) LEFT JOIN d ON d.k = v.k
"""
