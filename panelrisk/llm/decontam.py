"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are word windows of benchmark items. Texts and items are lower-cased (A-Z) and cut into words of
digits, letters a-z and anything that is not ASCII. Patterns of one length share a shift table over hashed
blocks of two words: where the last two words of a position's window end no pattern, the search skips as far as
no pattern can begin. A shift of zero leads to the bucket of patterns with that ending and first block, and a direct
comparison of all words confirms an occurrence. Many stretches of text are searched in step, so that each
skip is one numpy operation for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm import text as T
from panelrisk.llm.store import keyed, without

WINDOW = 10
#: Windows in one broadcast block of patterns (some 100 bytes each); a larger benchmark is searched block by block.
BLOCK = 200_000
#: Positions that one stretch of a text is searched over.
STRETCH = 512


def clean_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the row that each is in."""
    data = T.LOWER[data]
    starts, ends, rows = T.spans(data, offsets, T.ALNUM)
    return T.stretch_hashes(data, starts, ends), rows


class WuManber:
    """Search for patterns (rows of word hashes) of one length."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, self.m = patterns, patterns.shape[1]
        self.b = min(2, self.m)
        self.bits = max(12, int(np.ceil(np.log2(patterns.size + 1))) + 3)
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.int32)
        for q in range(self.b - 1, self.m):
            np.minimum.at(self.shift, self._slot(patterns[:, q - 1] if self.b == 2 else None, patterns[:, q]), self.m - 1 - q)
        keys = self._bucket(self._slot(patterns[:, -2] if self.b == 2 else None, patterns[:, -1]), patterns[:, 0], patterns[:, self.b - 1])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    @staticmethod
    def _bucket(slot: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Key of a bucket: the slot of the ending block and a hash of the first block."""
        return (slot.astype(np.uint64) << np.uint64(32)) | (T.mix(first * np.uint64(5) + second) >> np.uint64(32))

    def _slot(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        h = T.mix(last) if before is None else T.mix(before * np.uint64(3) + last)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence; none crosses rows."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
        lasts = np.r_[firsts[1:], len(rows)]
        n = np.maximum(lasts - firsts - self.m + 1, 0)
        parts = -(-n // STRETCH)
        begin = np.repeat(firsts + self.m - 1, parts) + STRETCH * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.minimum(begin + STRETCH, np.repeat(lasts, parts))
        at = begin
        while len(at):
            slots = self._slot(words[at - 1] if self.b == 2 else None, words[at])
            step = self.shift[slots]
            zero = np.flatnonzero(step == 0)
            if len(zero):
                self._confirm(words, at[zero], slots[zero], found)
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _confirm(self, words: np.ndarray, ends: np.ndarray, slots: np.ndarray, found: list) -> None:
        wanted = self._bucket(slots, words[ends - self.m + 1], words[ends - self.m + self.b])
        entry, last = np.searchsorted(self.keys, wanted, side="left"), np.searchsorted(self.keys, wanted, side="right")
        while len(ends):
            here = entry < last
            ends, entry, last = ends[here], entry[here], last[here]
            pattern, same = self.order[entry], np.ones(len(ends), bool)
            for t in range(self.m):
                same &= words[ends - self.m + 1 + t] == self.patterns[pattern, t]
            if same.any():
                found.append((ends[same] - self.m + 1, pattern[same]))
            entry = entry + 1


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, words: the windows of each item as word hashes; a shorter item is one window, one without words has none. item can be null."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column(1)):
                words, rows = clean_words(data, offsets)
                ids, out = batch.column(0).slice(lo, hi - lo).to_pylist(), ([], [])
                for k, own in enumerate(np.split(words, np.searchsorted(rows, np.arange(1, hi - lo)))):
                    for a in range(max(1, len(own) - window + 1) if len(own) else 0):
                        out[0].append(ids[k])
                        out[1].append(own[a : a + window].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int64()))], names=["item", "words"])

    return items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(windows, "item string, words array<long>").distinct()


def _hits(docs: DataFrame, patterns: list) -> DataFrame:
    """doc_id, id, th, n_words, starts, stops, items: where windows of one block of patterns occur."""
    shared = docs.sparkSession.sparkContext.broadcast([([r["words"] for r in patterns], [r["items"] for r in patterns])])
    built: list = []

    def build() -> list:
        words, items = shared.value[0]
        sizes = np.array([len(w) for w in words])
        out = []
        for m in sorted(set(sizes.tolist())):
            which = np.flatnonzero(sizes == m)
            out.append((WuManber(np.array([words[k] for k in which], np.int64).view(np.uint64)), [items[k] for k in which]))
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.extend(build())
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column(1)):
                words, rows = clean_words(data, offsets)
                n = hi - lo
                first = np.searchsorted(rows, np.arange(n))
                starts, stops, items = ([[] for _ in range(n)] for _ in range(3))
                for matcher, of in built:
                    at, pattern = matcher.search(words, rows)
                    for a, p in zip(at.tolist(), pattern.tolist(), strict=True):
                        k = int(rows[a])
                        starts[k].append(a - int(first[k]))
                        stops[k].append(a - int(first[k]) + matcher.m)
                        items[k].extend(of[p])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), batch.column(3).slice(lo, n), pa.array(np.bincount(rows, minlength=n), pa.int64()),
                     pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                    names=["doc_id", "id", "th", "n_words", "starts", "stops", "items"],
                )

    return docs.mapInArrow(find, "doc_id long, id long, th long, n_words long, starts array<int>, stops array<int>, items array<string>")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, id, th, n_words, starts, stops, items of every row of docs: the word spans that windows cover."""
    windows = item_windows(items, window).groupBy("words").agg(F.collect_set("item").alias("items"))
    n = max(1, -(-windows.count() // block))
    docs, found = keyed(docs), None
    for k in range(n):
        part = _hits(docs, windows.where(F.pmod(F.xxhash64("words"), F.lit(n)) == k).collect())
        found = part if found is None else found.unionAll(part)
    if n == 1:
        return found
    join = lambda c: F.flatten(F.collect_list(c))
    together = found.groupBy("doc_id", "id", "th").agg(F.first("n_words").alias("n_words"), join("starts").alias("starts"), join("stops").alias("stops"), F.array_distinct(join("items")).alias("items"), (F.count(F.lit(1)) / n).cast("int").alias("rows"))
    return together.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rows", "_k")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Nulls have no words; windows of items with a null id are hit like others, but such an item has no name to be counted or
    listed by; items with equal ids count once; rows with equal doc_id stay separate rows. Texts of any length are searched whole.
    Without items nothing is contaminated.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, names = [], []
            for starts, stops, items in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                end = hit = 0
                for a, b in sorted(zip(starts, stops, strict=True)):
                    hit += max(0, b - max(a, end))
                    end = max(end, b)
                hits.append(hit)
                names.append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array([h > 0 for h in hits], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    found = occurrences(docs, items, window, block).select("doc_id", "n_words", "starts", "stops", "items")
    return found.mapInArrow(digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with their columns as they are."""
    return without(docs, occurrences(docs, items, window, block).where(F.size("starts") > 0).select("id", "th"))
