"""Substring dedup over words by level-wise doubling.

A window of `window` words is removed where the same words also start in a document with a smaller id. Short
windows come first: of each text only those at content-chosen positions (every long window holds one, and equal
long windows hold equal ones) are compared. Windows that are repeated in another document, and these alone, are
extended to twice their length, again at chosen positions, until the length is that of the operator; there
every window whose chosen part is still a candidate is compared. Equal texts are told apart first, so that
of a group of copies only the first takes part.

Windows around one chosen position go to one bucket, so that runs of them travel packed. Where a part of this kind
holds a large share of all chosen positions (a passage that very many documents hold, whose edges differ),
the windows around it are dealt by their own hashes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm import text as T
from panelrisk.llm.store import bucket_count, keyed, keyed_rows, own_columns, private, written

WINDOW = 50
#: Length of the first level; doubled up to the window.
BASE = 25
#: Words of all texts for each bucket of windows; the windows of a bucket are held together.
PER_BUCKET = 8_000_000


def _words(data: np.ndarray, offsets: np.ndarray, window: int):
    """Rows and hashes of the words, first word of each row (and their number), which windows lie in one row."""
    starts, ends, rows = T.spans(data, offsets, T.SPACED)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    n = len(rows) - window + 1
    valid = rows[window - 1 :] == rows[:n] if n > 0 else np.zeros(0, bool)
    return rows, T.stretch_hashes(data, starts, ends), first, valid


def text_sums(docs: DataFrame) -> DataFrame:
    """doc_id, id, th, n_words and the sha256 of all words, joined by one space."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            counts, out = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                words = data[a:b].tobytes().split()
                counts.append(len(words))
                out.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2, 3)), pa.array(counts, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "id", "th", "n_words", "sha"])

    return docs.mapInArrow(sums, "doc_id long, id long, th long, n_words long, sha string")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and lo of those keys that two documents or more have; lo is the least id. Summed up before the shuffle."""
    return rows.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("hi")


class Packer:
    """Runs of window hashes, packed by bucket for the shuffle.

    Equal windows share a bucket. What the windows of one chunk already tell is settled before the shuffle, so
    that of a hash that very many documents have, a chunk sends only one document's windows: with `least`, windows
    of documents with a larger id than another one of the chunk are repeated for certain; without, all windows
    that two documents of the chunk have, and two of these still go to the bucket, as another chunk's window can be
    the same as one of them (`who`). Settled runs travel along, without hashes; they have nothing to meet and are
    dealt by document.
    """

    SCHEMA = "bucket int, n long, ids binary, starts binary, sizes binary, h binary, g binary, who binary"
    CHUNK = 400_000

    def __init__(self, buckets: int, least: bool):
        self.buckets, self.least, self.parts, self.n = buckets, least, [], 0

    def add(self, ids: np.ndarray, pos: np.ndarray, h: np.ndarray, g: np.ndarray, key: np.ndarray, who: np.ndarray | None = None) -> None:
        """One entry for each window; key chooses the bucket. who: what must differ for a window to be repeated, by default the id."""
        self.own = who is not None
        self.parts.append((ids, pos, h, g, (key % np.uint64(self.buckets)).astype(np.int64), ids if who is None else who.view(np.int64)))
        self.n += len(ids)

    def full(self) -> bool:
        return self.n >= self.CHUNK

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        ids, pos, h, g, bucket, who = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.lexsort((who, g, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
        group = np.cumsum(new) - 1
        last = np.r_[new[1:], True]
        lo, hi = who[order][new], who[order][last]
        settled = np.empty(len(ids), bool)
        settled[order] = who[order] > lo[group] if self.least else (lo < hi)[group]
        # without `least`, two different windows of a settled hash still have to tell other chunks
        extra = order[(new | last) & (lo < hi)[group]] if not self.least else order[:0]
        rows = []
        for done, which in ((True, np.flatnonzero(settled)), (False, np.sort(np.concatenate([np.flatnonzero(~settled), extra])))):
            if not len(which):
                continue
            b = (T.mix(ids[which].view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64) if done else bucket[which]
            order = np.argsort(b, kind="stable")
            which, b = which[order], b[order]
            i, p = ids[which], pos[which]
            begin = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (i[1:] != i[:-1]) | (p[1:] != p[:-1] + 1)])
            stop = np.r_[begin[1:], len(which)]
            edges = np.flatnonzero(np.r_[True, b[begin][1:] != b[begin][:-1]])
            for x, y in zip(edges.tolist(), np.r_[edges[1:], len(begin)].tolist(), strict=True):
                u, v = begin[x], stop[y - 1]
                own = which[u:v]
                rows.append((int(b[u]), y - x, planes(i[begin[x:y]]), planes(p[begin[x:y]].astype(np.int32)), planes((stop[x:y] - begin[x:y]).astype(np.int32)), *((None,) * 3 if done else (h[own].tobytes(), g[own].tobytes(), who[own].tobytes() if self.own else None))))
        names = ["bucket", "n", "ids", "starts", "sizes", "h", "g", "who"]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        for k in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256], strict=True), kinds, strict=True)], names=names)


def planes(x: np.ndarray) -> bytes:
    """The bytes of integers, those of equal weight together: what they share is compressed away in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def settle(table: pa.Table, least: bool) -> pa.Table:
    """id, runs of the packed windows of one bucket that are repeated."""
    ids, starts, sizes, h, g, who, done = [], [], [], [], [], [], []
    for row in table.to_pylist():
        ids.append(unplaned(row["ids"], np.int64))
        starts.append(unplaned(row["starts"], np.int32))
        sizes.append(unplaned(row["sizes"], np.int32))
        done.append(np.full(len(ids[-1]), row["h"] is None))
        if row["h"] is not None:
            h.append(np.frombuffer(row["h"], np.uint64))
            g.append(np.frombuffer(row["g"], np.uint32))
            who.append(np.repeat(ids[-1], sizes[-1]) if row["who"] is None else np.frombuffer(row["who"], np.int64))
    ids, starts, sizes, done = (np.concatenate(x) for x in (ids, starts, sizes, done))
    out = [(ids[done], starts[done], sizes[done])]
    if h:
        h, g, who = np.concatenate(h), np.concatenate(g), np.concatenate(who)
        ids, starts, sizes = ids[~done], starts[~done], sizes[~done]
        run = np.repeat(np.arange(len(ids)), sizes)
        own = ids[run]
        order = np.lexsort((who, g, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
        group = np.cumsum(new) - 1
        lo, hi = who[order][new], who[order][np.r_[np.flatnonzero(new)[1:] - 1, len(order) - 1]]
        again = np.empty(len(own), bool)
        again[order] = who[order] > lo[group] if least else (lo < hi)[group]
        which = np.flatnonzero(again)
        if len(which):
            pos = starts[run] + np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begin = np.flatnonzero(np.r_[True, (run[which][1:] != run[which][:-1]) | (which[1:] != which[:-1] + 1)])
            out.append((own[which[begin]], pos[which[begin]].astype(np.int32), np.diff(np.r_[begin, len(which)]).astype(np.int32)))
    ids, starts, sizes = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(ids, kind="stable")
    ids, pairs = ids[order], np.stack([starts[order], sizes[order]], axis=1).astype(np.int32).reshape(-1)
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    return pa.table([pa.array(ids[first]), pa.ListArray.from_arrays(pa.array(np.r_[2 * first, 2 * len(ids)].astype(np.int32)), pa.array(pairs))], names=["id", "runs"])


def settled(packed: DataFrame, least: bool) -> DataFrame:
    """id, runs: first words and lengths, one after the other, of the runs of repeated windows.

    One bucket is one group; a chunk sends a bounded number of windows of any hash to it.
    """

    return packed.groupBy("bucket").applyInArrow(lambda table: settle(table, least), "id long, runs array<int>")


def expanded(runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and position of everything in a column of runs."""
    flat = runs.flatten().to_numpy().reshape(-1, 2).astype(np.int64)
    row = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()) // 2)
    size = flat[:, 1]
    return np.repeat(row, size), np.repeat(flat[:, 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def heavy_hashes(texts: DataFrame, chosen: Callable[[np.ndarray, np.ndarray], np.ndarray], share: float, name: str) -> np.ndarray:
    """Hashes among those chosen in the texts (bytes, offsets) that hold `share` of all or more; ascending, at most 1 / share.

    Each chunk tells those that hold this share of its own; a hash with twice the share of all is found for certain.
    """

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            total = int(counts.sum())
            some = counts >= share * total
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(keys[some].view(np.int64))]), pa.array(np.r_[total, counts[some]])], names=["h", "n"])

        for batch in batches:
            for _, _, data, offsets in T.pieces(batch.column(0)):
                found = chosen(data, offsets)
                if len(found):
                    parts.append(found)
                if sum(map(len, parts)) > Packer.CHUNK:
                    yield from flush()
                    parts.clear()
        if parts:
            yield from flush()

    sums = written(texts.select("text").mapInArrow(heavy, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), name)
    total = sums.where("h IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = sums.where("h IS NOT NULL").where(F.col("n") >= share * total).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def is_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the known ones (ascending)."""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def hot_anchors(texts: DataFrame, window: int, k: int, buckets: int) -> np.ndarray:
    """Hashes of k words that hold a large share (1 / (8 * buckets)) of the positions chosen in windows."""

    def chosen(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, words, _, valid = _words(data, offsets, window)
        grams = T.window_hashes(words, k)
        return grams[T.minimizers(grams, window - k + 1, valid)]

    return heavy_hashes(texts, chosen, 1 / (8 * buckets), "hot-anchors")


def level(texts: DataFrame, window: int, k: int, before: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed windows of k words of texts (text, id and, with before > 0, runs).

    k < window: those chosen in each `window`. before: length of the windows that runs holds the candidates of;
    a window is left out if the one of `before` words that is chosen in it is no candidate. hot: chosen windows of `before`
    words whose surroundings are dealt by their own hashes.
    """
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, k == window)
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column(0)):
                rows, words, first, valid = _words(data, offsets, window)
                if not valid.any():
                    continue
                if before:
                    row, at = expanded(batch.column(2).slice(lo, hi - lo))
                    grams, at = T.window_hashes(words, before), at + first[row]
                    own = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
                    at = at[at < len(grams)]
                    own[at] = grams[at]
                    chosen = T.slide(grams, window - before + 1, np.minimum)
                    valid = valid & (chosen == T.slide(own, window - before + 1, np.minimum))
                longer = T.window_hashes(words, k)
                if k < window:
                    at = T.minimizers(longer, window - k + 1, valid)
                    key, g = longer[at], np.zeros(len(at), np.uint32)
                else:
                    at = np.flatnonzero(valid)
                    key = longer[at]
                    if before:
                        near = chosen[at]
                        key = np.where(is_in(near, shared.value), key, near)
                    g = (T.window_hashes(words, k, salt=77)[at] >> np.uint64(32)).astype(np.uint32)
                ids = batch.column(1).slice(lo, hi - lo).to_numpy()
                packer.add(ids[rows[at]], at - first[rows[at]], longer[at], g, key)
                if packer.full():
                    yield from packer.flush()
        yield from packer.flush()

    return texts.mapInArrow(pack, Packer.SCHEMA)


def removed_windows(docs: DataFrame, later: DataFrame, n_words: int, window: int, base: int) -> DataFrame:
    """id, runs of the windows to remove; later: ids that are copies of a smaller one, and take no part."""
    buckets = bucket_count(docs.sparkSession, n_words, PER_BUCKET)
    texts, k, before, found = keyed(docs).select("text", "id"), min(base, window), 0, None
    while True:
        own = texts if found is None else texts.join(found, "id").select("text", "id", "runs")
        hot = hot_anchors(texts, window, before, buckets) if k == window and before else np.zeros(0, np.uint64)
        found = settled(level(own, window, k, before, buckets, hot), k == window).groupBy("id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        if k == window:
            return found
        found = found.join(later, "id", "left_anti")
        before, k = k, min(2 * k, window)


def kept_words(docs: DataFrame, removed: DataFrame, window: int) -> DataFrame:
    """id, th, n_removed, sha, kept (the text left) of the rows that lose words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for text, runs in zip(batch.column(0), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split()
                change = np.zeros(len(words) + window + 1, np.int32)
                start, size = runs.values.to_numpy().reshape(-1, 2).T.astype(np.int64)
                inside = start + size + window - 1 <= len(words)  # runs of another text with the same id can be outside
                np.add.at(change, start[inside], 1)
                np.add.at(change, (start + size + window - 1)[inside], -1)
                covered = np.cumsum(change)[: len(words)] > 0
                gone.append(int(covered.sum()))
                kept.append(b" ".join(words[k] for k in np.flatnonzero(~covered).tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([x.decode() for x in kept], pa.string())],
                names=["id", "th", "n_removed", "sha", "kept"],
            )

    texts = keyed(docs).select("text", "id", "th").join(removed, "id").select("text", "id", "th", "runs")
    return texts.mapInArrow(cut, "id long, th long, n_removed long, sha string, kept string")


def _parts(docs: DataFrame, window: int, base: int) -> tuple[DataFrame, DataFrame]:
    """All rows with n_words, sha and copy (equal to a text with a smaller id), and the runs to remove."""
    table = written(text_sums(keyed(docs)), "text-sums")
    copies = repeated(table.select("id", "sha", "n_words"), "sha", "n_words")
    marked = written(table.join(copies, ["sha", "n_words"], "left").withColumn("copy", F.col("id") > F.coalesce("lo", "id")).drop("lo"), "marked")
    n_words = table.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    return marked, removed_windows(docs, marked.where("copy").select("id").distinct(), n_words, window, base)


def substring_digest(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs.

    A null text has no words. A null doc_id counts as the largest. Ids are taken to be unique: of rows with one
    doc_id, equal ones have the same result and remove nothing from each other. Texts of fewer words than the window
    lose nothing.
    """
    marked, removed = _parts(docs, window, base)
    cut = kept_words(docs, removed, window).select("id", "th", F.col("n_removed").alias("_n"), F.col("sha").alias("_sha")).dropDuplicates(["id", "th"])
    whole = F.col("copy") & (F.col("n_words") >= window)
    return marked.join(cut, ["id", "th"], "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """docs with the words left as text: joined by single spaces where words were removed, else as they were."""
    marked, removed = _parts(docs, window, base)
    cut = kept_words(docs, removed, window).where("n_removed > 0").select("id", "th", "kept").dropDuplicates(["id", "th"])
    gone = marked.where(F.col("copy") & (F.col("n_words") >= window)).select("id", "th", F.lit("").alias("kept")).distinct()
    own, i, t = keyed_rows(docs)
    new = private(own, "_kept")
    left = cut.unionByName(gone).select(F.col("id").alias(i), F.col("th").alias(t), F.col("kept").alias(new))
    return own.join(left, [i, t], "left").withColumn("text", F.coalesce(F.col(new), F.col("text"))).select(*own_columns(docs))


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS i FROM h JOIN f USING (h) WHERE h.doc_id > f.lo),
e AS (SELECT doc_id, len(words) AS n, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w WHERE len(words) > 0),
k AS (
  SELECT e.doc_id, count(r.i) AS n_removed, string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE r.i IS NULL) AS kept
  FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.i = r.i GROUP BY e.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
