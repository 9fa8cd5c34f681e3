"""Embedding near-dedup with an inverted multi-index.

Vectors of unit length are cut in halves; each half has a codebook, and the pairs of codes form a grid of cells in
which every vector is filed. A vector visits cells in ascending order of the sum of its two distances to the codes
(multi-sequence traversal) until the number that the target recall needs, and is compared exactly, in double
precision, with all vectors filed there. Codebooks and that number are fitted on a bounded sample; cells are compared
block by block, so that a full cell is spread over many tasks and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from panelrisk.llm.components import components
from panelrisk.llm.store import NO_ID, written

SIMILAR, RECALL = 0.9, 0.97
#: Vectors that the codebooks are fitted on, at most, and those that the number of cells is set with.
SAMPLE, PROBES = 20_000, 400
#: Vectors of a cell in one block, of those filed and of those that visit.
FILED, VISITING = 256, 512
#: Vectors for each cell that the size of the grid aims at, and the most codes of a half.
PER_CELL, CODES = 200, 2048
#: Cells of a grid up to which the table of their sizes is broadcast (some 50 bytes a row); beyond it, sizes join by a shuffle.
BROADCAST_CELLS = 65_536


def _kind(vectors: DataFrame) -> type:
    """Components are kept in single precision where they come in it; they are computed with in double precision."""
    held = vectors.schema["embedding"].dataType
    return np.float32 if isinstance(held, ArrayType) and isinstance(held.elementType, FloatType) else np.float64


def _prepared(vectors: DataFrame, kind: type) -> DataFrame:
    """uid, vec_id, id and raw: the components as bytes; null for vectors that link with nothing."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw = []
            for x in batch.column(1):
                v = np.array([np.nan if y is None else y for y in x.as_py()] if x.is_valid else [], np.float64)
                size = np.sqrt(v @ v) if len(v) and np.isfinite(v).all() else 0.0
                if not 0 < size < np.inf and len(v) and np.isfinite(v).all() and v.any():
                    v = v / np.abs(v).max()  # squares left the range of doubles
                    size = 1.0
                raw.append(v.astype(kind).tobytes() if 0 < size < np.inf else None)
            yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(len(raw))), batch.column(0), pa.array(raw, pa.binary())], names=["uid", "vec_id", "raw"])
            uid += len(raw)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(prepare, "uid long, vec_id long, raw binary").withColumn("id", F.coalesce("vec_id", F.lit(NO_ID)))


def unit(raw: list[bytes], kind: type = np.float64) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def codebook(points: np.ndarray, codes: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centres of k-means over the points."""
    centres = points[np.random.default_rng(seed).permutation(len(points))[:codes]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([distances(x, centres).argmin(axis=1) for x in np.array_split(points, -(-len(points) // 1024))])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        count = np.bincount(nearest, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None, :]


def traversal(v: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    """The nearest cells of each vector in ascending order of distance, at most `cells`.

    In the order of codes by distance in either half, a cell (i, j) can be among the first n only if (i + 1) * (j + 1) <= n,
    as all cells below it come before; those alone are summed and sorted.
    """
    h = v.shape[1] // 2
    near = [distances(x, b) for x, b in ((v[:, :h], books[0]), (v[:, h:], books[1]))]
    order = [d.argsort(axis=1, kind="stable") for d in near]
    own = [np.take_along_axis(d, o, axis=1) for d, o in zip(near, order, strict=True)]
    i, j = np.indices([min(cells, len(b)) for b in books]).reshape(2, -1)
    some = (i + 1) * (j + 1) <= cells
    i, j = i[some], j[some]
    first = (own[0][:, i] + own[1][:, j]).argsort(axis=1, kind="stable")[:, :cells]
    at = [np.take_along_axis(o, x[first], axis=1) for o, x in zip(order, (i, j), strict=True)]
    return at[0] * len(books[1]) + at[1]


def cells_needed(v: np.ndarray, books: tuple[np.ndarray, np.ndarray], similar: float, recall: float, seed: int = 11) -> int:
    """Cells that a vector has to visit for the share `recall` of vectors at a cosine of just `similar`."""
    rng = np.random.default_rng(seed)
    noise = rng.standard_normal(v.shape)
    noise -= (noise * v).sum(axis=1)[:, None] * v
    size = np.sqrt((noise * noise).sum(axis=1))[:, None]
    other = similar * v + np.sqrt(max(0.0, 1 - similar**2)) * noise / np.where(size > 0, size, 1)
    h = v.shape[1] // 2
    near = distances(v[:, :h], books[0]), distances(v[:, h:], books[1])
    home = traversal(other, books, 1)[:, 0]
    # as many cells as lie no farther than that of the other vector
    rank = np.array([(x[:, None] + y[None, :] <= x[c // len(y)] + y[c % len(y)]).sum() for x, y, c in zip(*near, home, strict=True)])
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1)])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from nodes to one node of their component, for the component's nodes among a and b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compared(blocks: DataFrame, similar: float, kind: type) -> DataFrame:
    """a, b, n: with b null, n links of a were found; else a and b are in one component."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for k in range(batch.num_rows):
                cell = batch.column(0)[k].as_py()
                filed, visiting = (batch.column(c)[k].values for c in (1, 2))
                u, q = (unit(x.field("raw").to_pylist(), kind) for x in (filed, visiting))
                uid, qid = filed.field("uid").to_numpy(), visiting.field("uid").to_numpy()
                um, qm = filed.field("mult").to_numpy(), visiting.field("mult").to_numpy()
                r, c = np.nonzero(q @ u.T >= similar)
                other = qid[r] != uid[c]
                r, c = r[other], c[other]
                if not len(r):
                    continue
                # the filed one counts a visitor here only if it doesn't visit the visitor's own cell itself
                visits = [set(x) for x in filed.field("cells").to_pylist()]
                home = visiting.field("home").to_numpy()
                back = np.array([home[x] in visits[y] for x, y in zip(r.tolist(), c.tolist(), strict=True)])
                a, b = _forest(qid[r], uid[c])
                for lst, x in zip(out, (np.concatenate([qid[r], uid[c[~back]]]), np.concatenate([um[c], qm[r[~back]]]), a, b, [cell]), strict=True):
                    lst.append(np.asarray(x))
            if not out[0]:
                continue
            who, back = np.unique(np.concatenate(out[0]), return_inverse=True)
            many = np.bincount(back, weights=np.concatenate(out[1])).astype(np.int64)
            a, b = np.concatenate(out[2]), np.concatenate(out[3])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([who, a])), pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(b, pa.int64())]), pa.array(np.concatenate([many, np.zeros(len(a), np.int64)]))],
                names=["a", "b", "n"],
            )

    return blocks.mapInArrow(compare, "a long, b long, n long")


def _found(reps: DataFrame, kind: type, similar: float, recall: float, sample: int) -> DataFrame:
    """a, b, n (see _compared) for different vectors of one length; reps: uid, raw, mult."""
    spark, n = reps.sparkSession, reps.count()
    share = min(1.0, sample / max(1, n))
    chosen = reps.where(F.pmod(F.xxhash64("uid", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select("raw").limit(sample).collect()
    points = unit([bytes(r["raw"]) for r in chosen], kind)
    codes = int(np.clip(np.sqrt(n / PER_CELL), 1, min(CODES, len(points))))
    h = points.shape[1] // 2
    books = (codebook(points[:, :h], codes), codebook(points[:, h:], codes))
    cells = cells_needed(points[:PROBES], books, similar, recall)
    shared = spark.sparkContext.broadcast(books)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            visits = traversal(unit(batch.column(1).to_pylist(), kind), shared.value, cells)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits[:, 0], pa.int64()), pa.array(list(visits.astype(np.int64)), pa.list_(pa.int64()))], names=["uid", "raw", "mult", "home", "cells"])

    filed = written(reps.select("uid", "raw", "mult").mapInArrow(file, "uid long, raw binary, mult long, home long, cells array<long>"), "filed")
    visiting = filed.select(F.explode("cells").alias("cell"), "uid", "raw", "mult", "home")
    filed = filed.withColumn("cell", F.col("home"))

    def blocks(rows: DataFrame, size: int, name: str, *columns: str) -> DataFrame:
        """Rows of a cell in blocks of about `size`, numbered from 0; of visiting rows, also the number of blocks filed in the cell. One row counts a cell."""
        counted = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
        counted = counted.join(cells_filed, "cell")
        dealt = rows.join(F.broadcast(counted) if codes**2 <= BROADCAST_CELLS else counted, "cell").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))
        return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct(*columns)).alias(name), F.max("filed_parts").alias("filed_parts"))

    cells_filed = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / FILED).alias("filed_parts"))
    # each pair of a filed and a visiting block is a row of its own, dealt by cell and filed block, so that no task holds all pairs of a full cell
    visits = blocks(visiting, VISITING, "visiting", "uid", "raw", "mult", "home").drop("part").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("filed_parts") - 1)))
    both = blocks(filed, FILED, "filed", "uid", "raw", "mult", "cells").drop("filed_parts").join(visits, ["cell", "part"])
    return _compared(both.select("cell", "filed", "visiting"), similar, kind)


def vector_classes(vectors: DataFrame, similar: float = SIMILAR, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. Equal vectors
    are compared once and counted as often as they occur; vectors of different lengths have no cosine and do not link.
    Rows with equal vec_id are separate vectors; a null vec_id counts as the largest. An empty table gives none.
    """
    kind = _kind(vectors)
    table = written(_prepared(vectors, kind), "vectors")
    distinct = table.where("raw IS NOT NULL").groupBy("raw").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("mult"))
    reps = written(distinct, "distinct-vectors").withColumn("uid", F.col("rep"))
    found = None
    for (size,) in reps.select(F.length("raw")).distinct().collect():
        part = _found(reps.where(F.length("raw") == size), kind, similar, recall, sample)
        found = part if found is None else found.unionAll(part)
    copies = table.join(reps.select("raw", "rep", "mult"), "raw").select("uid", "rep", "mult")
    if found is None:
        return table.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "found")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    links = found.where("b IS NOT NULL").select("a", "b").unionAll(copies.select(F.col("uid").alias("a"), F.col("rep").alias("b")))
    placed = components(links).withColumnRenamed("node", "uid")
    own = table.select("uid", "vec_id", "id").join(copies, "uid", "left").join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(placed, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = own.groupBy("component").agg(F.min(F.struct("id", "vec_id")).alias("least"))
    return own.join(least, "component").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce("mult", F.lit(1)) - 1).alias("n_links"), F.col("least.vec_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("least.vec_id")).alias("kept"),
    )


VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT a, least(a, min(b)) AS lo FROM c GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.lo, e.vec_id)::BIGINT AS component_id, e.vec_id = coalesce(m.lo, e.vec_id) AS kept
FROM embeddings e LEFT JOIN m ON e.vec_id = m.a LEFT JOIN n ON e.vec_id = n.a
"""
