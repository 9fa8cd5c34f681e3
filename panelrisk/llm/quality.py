"""Quality classifier: Naive Bayes support vectors.

Features are indicators of hashed n-grams: of bytes (1 to 3) and of word shapes (1 to 4). A word's shape holds its
case, whether it has letters, digits and other signs, its length class, and whether it repeats the word before. Indicators are
scaled by the log-count ratio of the two classes; a linear hinge-loss model is fitted to them by dual
coordinate descent, and its margins are turned into scores by a logistic fit on rows held back from the descent.

The fit uses at most SAMPLE labelled rows, chosen by a hash of their ids; every row is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm import text as T
from panelrisk.llm.store import in_fold, keyed, without

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 6000
BITS = 16
SIZE = (1 << BITS) + 1
ACCEPT = 0.3
#: Texts whose flags (SIZE bytes each) are held at a time, however short they are.
ROWS = 64

_upper, _lower = T.byte_class((0x41, 0x5A)), T.byte_class((0x61, 0x7A))
_digit, _sign = T.byte_class((0x30, 0x39)), T.byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def _count(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[ends] - sums[starts]


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = T.spans(data, offsets, T.SPACED)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    size = ends - starts
    shape = np.minimum(_count(_upper[data], starts, ends), 2) * 3 + np.minimum(_count(_lower[data], starts, ends), 2)
    shape = shape * 4 + (_count(_digit[data], starts, ends) > 0) * 2
    shape = (shape * 4 + np.minimum(_count(_sign[data], starts, ends), 3)) * 4 + np.minimum(size // 4, 3)
    h = T.stretch_hashes(data, starts, ends)
    same = np.r_[False, (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])]
    return (shape * 2 + same).astype(np.uint64), rows


def indicators(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of SIZE flags for each text; the last flag is the constant."""
    n = len(offsets) - 1
    out = np.zeros((n, SIZE), bool)
    out[:, -1] = True
    flat = out.reshape(-1)
    if not len(data):
        return out
    rows = np.repeat(np.arange(n), np.diff(offsets))
    shapes, words = _shapes(data, offsets)
    for values, of, orders, salt in ((data.astype(np.uint64) + np.uint64(1), rows, (1, 2, 3), 11), (shapes + np.uint64(1), words, (1, 2, 3, 4), 23)):
        key = np.zeros(len(values), np.uint64)
        for k in orders:
            if len(values) < k:
                break
            key = key[: len(values) - k + 1] * np.uint64(1 << 13) + values[k - 1 :] if k > 1 else values.copy()
            slot = (T.mix(key * np.uint64(8) + np.uint64(salt + k)) >> np.uint64(64 - BITS)).astype(np.int64)
            inside = of[k - 1 :] == of[: len(of) - k + 1]
            flat[(of[: len(slot)] * SIZE + slot)[inside]] = True
    return out


def flagged(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows lo..hi, at most ROWS, with their indicators."""
    for lo, hi, data, offsets in T.pieces(column):
        for a in range(0, hi - lo, ROWS):
            own = offsets[a : min(a + ROWS, hi - lo) + 1]
            yield lo + a, lo + a + len(own) - 1, indicators(data[own[0] : own[-1]], own - own[0])


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: np.ndarray, size: int, rounds: int = 20, seed: int = 5) -> np.ndarray:
    """Weights of the linear hinge-loss model with an upper bound `cost` on each row's dual variable."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = np.array([v @ v for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for k in order.permutation(len(rows)):
            at, v = rows[k]
            if norm[k] <= 0:
                continue
            gradient = labels[k] * (w[at] @ v) - 1
            new = min(max(alpha[k] - gradient / norm[k], 0.0), cost[k])
            if new != alpha[k]:
                w[at] += (new - alpha[k]) * labels[k] * v
                most = max(most, abs(new - alpha[k]))
                alpha[k] = new
        if most < 1e-4:
            break
    return w


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of labels (0, 1) to margins, by damped Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(labels > 0, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(flags: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights on unit-length rows of scaled indicators, and the slope and intercept of scores."""
    held = np.arange(len(flags)) % 5 == 4
    if len({*labels[~held].tolist()}) < 2 or len({*labels[held].tolist()}) < 2:
        held[:] = False
    counts = np.ones((2, SIZE))
    for k in np.flatnonzero(~held):
        counts[int(labels[k])][flags[k]] += 1
    if len({*labels.tolist()}) < 2:
        return np.zeros((2, SIZE)), 0.0, 0.0
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[-1] = 1.0
    rows = []
    for f in flags:
        v = ratio[f]
        rows.append((f, v / max(1e-12, np.sqrt(v @ v))))
    own = np.flatnonzero(~held)
    share = labels[own].mean()
    cost = np.where(labels[own] > 0, 0.5 / share, 0.5 / (1 - share))
    w = dual_descent([rows[k] for k in own], np.where(labels[own] > 0, 1.0, -1.0), 4.0 * cost, SIZE)
    check = np.flatnonzero(held) if held.any() else own
    a, b = logistic(np.array([w[rows[k][0]] @ rows[k][1] for k in check]), labels[check].astype(float))
    return np.stack([w * ratio, ratio**2]), a, b


def training_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """key, quality, text of at most `sample` labelled documents outside the held-out fold, chosen by a hash of the id.

    Of rows with one id, one counts: the greatest text. Such rows are cut down to one before and after the shuffle.
    """
    own = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~in_fold(0)).withColumn("key", F.xxhash64("doc_id", F.lit(3)))
    share = sample / max(1, own.count())
    if share < 1:
        own = own.where(F.pmod("key", F.lit(1 << 30)) < F.lit(int(share * 1.05 * (1 << 30)) + 1))
    chosen = own.groupBy("key", "doc_id").agg(F.max("quality").alias("quality")).orderBy("key", "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("key", "doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text")).select("key", "quality", "text")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    """The model; fitted in one task, over the indicators of at most `sample` texts (SIZE flags each, at most)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, flags in flagged(batch.column(2)):
                rows, at = np.nonzero(flags)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), T.lists(at.astype(np.int32), rows, hi - lo, pa.int32())], names=["key", "quality", "flags"])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, labels_, keys = [], [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            labels_.append(batch.column(1).to_numpy())
            column = batch.column(2)
            flags += np.split(column.values.to_numpy().astype(np.int32), column.offsets.to_numpy()[1:-1])
        w, a, b = np.zeros((2, SIZE)), 0.0, 0.0
        if flags:
            order = np.argsort(np.concatenate(keys), kind="stable")
            w, a, b = fit([flags[k] for k in order], np.concatenate(labels_)[order])
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(w, np.float64).tobytes()], pa.binary()), pa.array([a]), pa.array([b])], names=["w", "a", "b"])

    rows = training_sample(docs, labels, sample).mapInArrow(features, "key long, quality int, flags array<int>").orderBy("key").coalesce(1).mapInArrow(model, "w binary, a double, b double").collect()
    if not rows:
        return np.zeros((2, SIZE)), 0.0, 0.0
    w = np.frombuffer(rows[0]["w"], np.float64)
    return (w.reshape(2, SIZE) if len(w) == 2 * SIZE else np.zeros((2, SIZE))), rows[0]["a"], rows[0]["b"]


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, id and th (key of the row), score of every row of docs.

    Null and empty texts score as the constant alone. With labels of one class, or none, every score is 0.5.
    Rows of equal text score alike; labels that contradict each other for an id count as 1.
    """
    w, a, b = fitted(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), a, b))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, a, b = shared.value
        for batch in batches:
            for lo, hi, flags in flagged(batch.column(1)):
                n = hi - lo
                margin, norm = (flags.astype(np.float32) @ w.T).astype(np.float64).T
                s = 1 / (1 + np.exp(-np.clip(a * margin / np.sqrt(np.maximum(norm, 1e-12)) + b, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), batch.column(3).slice(lo, n), pa.array(s)], names=["doc_id", "id", "th", "score"])

    return keyed(docs).mapInArrow(score, "doc_id long, id long, th long, score double")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    return scored(docs, labels, sample).select("doc_id", in_fold(0).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs whose score is `accept` or more, with their columns as they are."""
    return without(docs, scored(docs, labels, sample).where(F.col("score") < accept).select("id", "th"))
