"""Suffix-array dedup over bytes with the difference-cover algorithm.

Every byte that a string of `size` bytes covers which also starts elsewhere is removed. Each such string holds a
content-chosen anchor (the least hash of GRAM bytes in it), so equal strings hold equal anchors. Anchors that are met
once alone cannot be part of a repeated string; around the others, the stretch of bytes where strings with this anchor lie goes to the
anchor's bucket. In a bucket, the suffixes of all stretches are sorted by the difference-cover algorithm: triples
at positions not divisible by three are sorted and named, the names are sorted by recursion, and the remaining suffixes
are merged in. Recursion ends once names stand for `size` bytes. Then neighbours' first `size` bytes are compared. Equal
stretches of a chunk travel once, with all places where they lie, so that a passage that very many documents hold is
sent by each chunk once.

Around an anchor that very many places hold (the edges of a passage that a large part of all documents hold differ in
each), stretches are not sorted together: each string of `size` bytes there is dealt by its own hashes, so
that equal strings alone meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm import text as T
from panelrisk.llm.store import NO_ID, bucket_count, keyed, written
from panelrisk.llm.substring import Packer, expanded, heavy_hashes, is_in, planes, settle, settled, unplaned

SIZE, GRAM = 400, 100
#: Symbols that are sorted together, but for a single anchor with more; below it, three names fit into 64 bits.
TOGETHER = 1 << 19
#: Bytes of all texts for each bucket of anchors; the stretches of a bucket are held together.
PER_BUCKET = 64 << 20
#: Places from which an anchor is hot, and the most anchors that are.
HOT, MOST_HOT = 2048, 1 << 20


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks of the rows of columns (equal rows have equal ranks), from 1."""
    top = max(int(c.max(initial=0)) for c in columns) + 1
    if top ** len(columns) < 2**63:
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            key = key * top + c
        order = np.argsort(key)
        new = np.r_[True, key[order][1:] != key[order][:-1]]
    else:
        order = np.lexsort(columns[::-1])
        new = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes of s (integers from 1) in order; suffixes that agree in 3**depth symbols stay in any order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.r_[s, 0, 0, 0].astype(np.int64)
    one, two, zero = (np.arange(k, n + (n % 3 == 1) * (k == 1), 3) for k in (1, 2, 0))
    sample = np.r_[one, two]
    rank = np.zeros(n + 4, np.int64)
    names = _names(s[sample], s[sample + 1], s[sample + 2])
    if names.max() < len(sample) and depth > 1:
        order = suffix_order(names, depth - 1)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank[sample] = names
    by_rank = sample[np.argsort(names, kind="stable")]
    by_rank = by_rank[by_rank < n]
    zero = zero[np.argsort(_names(s[zero], rank[zero + 1]), kind="stable")]
    # of a remaining suffix, the sampled ones of either kind that come before it
    before = np.zeros(len(zero), np.int64)
    for k in (1, 2):
        own = by_rank[by_rank % 3 == k]
        both = np.r_[own, zero]
        key = _names(s[both], rank[both + 1]) if k == 1 else _names(s[both], s[both + 1], rank[both + 2])
        before += np.searchsorted(np.sort(key[: len(own)]), key[len(own) :], side="left")
    # suffixes that agree beyond the depth can be in different orders by the two keys
    place = np.maximum.accumulate(before) + np.arange(len(zero)) if len(zero) else before
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[place] = zero
    free[place] = False
    out[free] = by_rank
    return out


def repeated_starts(stretches: list[np.ndarray], size: int) -> list[np.ndarray]:
    """For each stretch of bytes, which of its strings of `size` bytes also start elsewhere in the stretches."""
    lengths = np.array([len(x) for x in stretches])
    first = np.cumsum(lengths + 1) - lengths - 1
    s = np.zeros(int((lengths + 1).sum()), np.int64)
    for a, x in zip(first.tolist(), stretches, strict=True):
        s[a : a + len(x)] = x.astype(np.int64) + 1
    s[first + lengths] = 257 + np.arange(len(stretches))  # ends differ, so that no match crosses them
    depth = 1
    while 3**depth < size:
        depth += 1
    order = suffix_order(s, depth)
    whole = np.zeros(len(s), bool)
    for a, n in zip(first.tolist(), lengths.tolist(), strict=True):
        whole[a : a + n - size + 1] = True
    order = order[whole[order]]
    h = T.rolled(T.prefix(T.mix(s.astype(np.uint64))), order, order + size)
    same = h[1:] == h[:-1]
    again = np.zeros(len(s), bool)
    again[order] = np.r_[same, False] | np.r_[False, same]
    return [again[a : a + n - size + 1] for a, n in zip(first.tolist(), lengths.tolist(), strict=True)]


def _grams(data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """Row of each byte, hashes of `gram` bytes by first byte, and which strings of `size` bytes lie in one row."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(data) - size + 1
    valid = rows[size - 1 :] == rows[:n] if n > 0 else np.zeros(0, bool)
    return rows, T.window_hashes(T.BYTE_VALUES[data], gram), valid


def text_sums(docs: DataFrame) -> DataFrame:
    """doc_id, id, th, n_bytes and sha256 of every text."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            view = memoryview(data)
            out = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (0, 2, 3)), pa.array(np.diff(offsets)), pa.array(out, pa.string())], names=["doc_id", "id", "th", "n_bytes", "sha"])

    return docs.mapInArrow(sums, "doc_id long, id long, th long, n_bytes long, sha string")


def anchors(docs: DataFrame, size: int, gram: int, buckets: int) -> DataFrame:
    """id, runs: places of the anchors that another place holds as well, copies of the whole text not counted."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, False)
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column(0)):
                rows, grams, valid = _grams(data, offsets, size, gram)
                at = T.minimizers(grams, size - gram + 1, valid)
                if len(at):
                    ids, th = (batch.column(c).slice(lo, hi - lo).to_numpy()[rows[at]] for c in (1, 2))
                    pos = at - offsets[rows[at]]
                    packer.add(ids, pos, grams[at], np.zeros(len(at), np.uint32), grams[at], T.mix(th.view(np.uint64) + pos.astype(np.uint64) * np.uint64(T.MULT)))
                if packer.full():
                    yield from packer.flush()
        yield from packer.flush()

    packed = docs.select("text", "id", "th").mapInArrow(pack, Packer.SCHEMA)
    return settled(packed, False).groupBy("id").agg(F.flatten(F.collect_list("runs")).alias("runs"))


class Stretches:
    """Stretches around anchors by bucket; those of a chunk that are equal are sent once, with all their places."""

    SCHEMA = "bucket int, anchors binary, lengths binary, bytes binary, of binary, ids binary, starts binary"
    CHUNK = 64 << 20

    def __init__(self, buckets: int):
        self.buckets, self.own, self.n = buckets, {}, 0

    def add(self, anchor: int, raw: bytes, place: tuple[int, int]) -> None:
        places = self.own.setdefault((anchor, raw), [])
        places.append(place)
        self.n += 40 + (len(raw) + 150 if len(places) == 1 else 0)

    def flush(self) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for key, places in self.own.items():
            by.setdefault(key[0] % self.buckets, []).append((key, places))
        for bucket, rows in by.items():
            many = [len(p) for _, p in rows]
            ids, starts = (np.array([q[k] for _, p in rows for q in p], np.int64) for k in (0, 1))
            cells = [planes(np.array([k[0] for k, _ in rows], np.uint64)), planes(np.array([len(k[1]) for k, _ in rows], np.int32)), b"".join(k[1] for k, _ in rows), planes(np.repeat(np.arange(len(rows), dtype=np.int32), many)), planes(ids), planes(starts)]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], names=["bucket", "anchors", "lengths", "bytes", "of", "ids", "starts"])
        self.own, self.n = {}, 0


#: Rows of Stretches and of Packer in one table.
BOTH = f"{Stretches.SCHEMA}, n long, sizes binary, h binary, g binary, who binary"


def hot_anchors(docs: DataFrame, n_bytes: int, size: int, gram: int) -> np.ndarray:
    """Anchors that HOT places or more hold (by the expected number of anchors), for certain those with twice as many."""

    def chosen(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, grams, valid = _grams(data, offsets, size, gram)
        return grams[T.minimizers(grams, size - gram + 1, valid)]

    places = 2 * n_bytes / (size - gram + 2)
    return heavy_hashes(docs, chosen, max(HOT / places, 1 / MOST_HOT), "hot-stretches") if places > HOT else np.zeros(0, np.uint64)


def stretches(texts: DataFrame, size: int, gram: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Stretches of texts (text, id, runs of anchors that are left) in which strings with such an anchor lie.

    Around hot anchors, packed strings with their own hashes instead (anchors is null).
    """
    shared = texts.sparkSession.sparkContext.broadcast(hot)
    columns = [f.split()[0] for f in BOTH.split(", ")]

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(c) if c in b.schema.names else pa.nulls(b.num_rows, {"n": pa.int64()}.get(c, pa.binary())) for c in columns], names=columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, packer = Stretches(buckets), Packer(buckets, False)
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column(0)):
                rows, grams, valid = _grams(data, offsets, size, gram)
                if not valid.any():
                    continue
                row, at = expanded(batch.column(2).slice(lo, hi - lo))
                at = np.unique(at + offsets[row])
                own = np.full(len(grams), np.iinfo(np.uint64).max, np.uint64)
                own[at[at < len(grams)]] = grams[at[at < len(grams)]]
                w = size - gram + 1
                least = T.slide(grams, w, np.minimum)[: len(valid)]
                possible = np.flatnonzero(valid & (least == T.slide(own, w, np.minimum)[: len(valid)]))
                if not len(possible):
                    continue
                often = is_in(least[possible], shared.value)
                if often.any():
                    own, possible = possible[often], possible[~often]
                    id, pos = batch.column(1).slice(lo, hi - lo).to_numpy()[rows[own]], own - offsets[rows[own]]
                    h, g = (T.window_hashes(T.BYTE_VALUES[data], size, salt)[own] for salt in (0, 77))
                    packer.add(id, pos, h, (g >> np.uint64(32)).astype(np.uint32), h, T.mix(id.view(np.uint64) + pos.astype(np.uint64) * np.uint64(T.MULT)))
                    if packer.full():
                        yield from packer.flush()
                    if not len(possible):
                        continue
                begin = np.flatnonzero(np.r_[True, (possible[1:] != possible[:-1] + 1) | (least[possible][1:] != least[possible][:-1]) | (rows[possible][1:] != rows[possible][:-1])])
                ends = np.r_[begin[1:], len(possible)] - 1
                raw, ids = data.tobytes(), batch.column(1).slice(lo, hi - lo).to_pylist()
                for a, b in zip(possible[begin].tolist(), possible[ends].tolist(), strict=True):
                    out.add(int(least[a]), raw[a : b + size], (ids[rows[a]], a - int(offsets[rows[a]])))
            if out.n > Stretches.CHUNK:
                yield from out.flush()
        yield from out.flush()
        yield from packer.flush()

    return texts.mapInArrow(lambda batches: both(cut(batches)), BOTH)


def sorted_out(packed: DataFrame, size: int) -> DataFrame:
    """id, runs: the strings of `size` bytes that start elsewhere, by suffix arrays of each bucket's stretches, or by hash."""

    def sort(table: pa.Table) -> pa.Table:
        own, dealt = (table.filter(f(table["anchors"])) for f in (pc.is_valid, pc.is_null))
        out = [*([suffixes(own)] if own.num_rows else []), *([settle(dealt, False)] if dealt.num_rows else [])]
        return pa.concat_tables([x.cast(pa.schema([("id", pa.int64()), ("runs", pa.list_(pa.int32()))])) for x in out])

    def suffixes(table: pa.Table) -> pa.Table:
        keys, parts, places = [], [], []
        for row in table.to_pylist():
            lengths = unplaned(row["lengths"], np.int32)
            raw, ends = np.frombuffer(row["bytes"], np.uint8), np.cumsum(lengths)
            of = unplaned(row["of"], np.int32)
            where = np.split(np.arange(len(of)), np.searchsorted(of, np.arange(1, len(lengths))))
            ids, starts = unplaned(row["ids"], np.int64), unplaned(row["starts"], np.int64)
            keys.append(unplaned(row["anchors"], np.uint64))
            parts += np.split(raw, ends[:-1])
            places += [(ids[x], starts[x]) for x in where]
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        edges = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1], True])
        out_ids, out_runs, held, n = [], [], [], 0

        def finish() -> None:
            for k, again in zip(held, repeated_starts([parts[k] for k in held], size), strict=True):
                ids, starts = places[k]
                if len(ids) > 1:
                    again = np.ones(len(again), bool)
                change = np.flatnonzero(np.diff(np.r_[False, again, False].astype(np.int8)))
                for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                    for i, s in zip(ids.tolist(), starts.tolist(), strict=True):
                        out_ids.append(i)
                        out_runs.append([s + a, b - a])

        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            group = order[a:b].tolist()
            if len(group) == 1 and len(places[group[0]][0]) == 1:  # alone; it may still hold a string twice
                if len(parts[group[0]]) == size:
                    continue
            more = sum(len(parts[k]) + 1 for k in group)
            if held and n + more > TOGETHER:
                finish()
                held, n = [], 0
            held, n = held + group, n + more
        if held:
            finish()
        return pa.table([pa.array(out_ids, pa.int64()), pa.array(out_runs, pa.list_(pa.int32()))], names=["id", "runs"])

    found = packed.groupBy("bucket").applyInArrow(sort, "id long, runs array<int>")
    return found.groupBy("id").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def kept_bytes(docs: DataFrame, removed: DataFrame, size: int) -> DataFrame:
    """id, th, n_removed, n_spans, sha, kept of the rows that lose bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, spans, kept = [], [], []
            for text, runs in zip(batch.column(0), batch.column(3), strict=True):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                change = np.zeros(len(raw) + 1, np.int64)
                start, many = runs.values.to_numpy().reshape(-1, 2).T.astype(np.int64)
                inside = start + many + size - 1 <= len(raw)  # runs of another text with the same id can be outside
                np.add.at(change, start[inside], 1)
                np.add.at(change, (start + many + size - 1)[inside], -1)
                covered = np.cumsum(change)[: len(raw)] > 0
                gone.append(int(covered.sum()))
                spans.append(int((covered & ~np.r_[False, covered[:-1]]).sum()))
                kept.append(raw[~covered].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
                names=["id", "th", "n_removed", "n_spans", "sha", "kept"],
            )

    texts = keyed(docs).select("text", "id", "th").join(removed, "id").select("text", "id", "th", "runs")
    return texts.mapInArrow(cut, "id long, th long, n_removed long, n_spans long, sha string, kept binary")


def _parts(docs: DataFrame, size: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """All rows with n_bytes, sha and copied (their text occurs more than once), and the strings to remove."""
    table = written(text_sums(keyed(docs)), "byte-sums")
    copies = table.groupBy("sha", "n_bytes").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("c")).where("c > 1")
    marked = written(table.join(copies, ["sha", "n_bytes"], "left").withColumn("copied", F.col("c").isNotNull()), "byte-copies")
    later = marked.where("copied AND id > lo").select("id").distinct()
    n_bytes = table.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    buckets, hot = bucket_count(docs.sparkSession, n_bytes, PER_BUCKET), hot_anchors(keyed(docs), n_bytes, size, gram)
    found = anchors(keyed(docs), size, gram, buckets).join(later, "id", "left_anti")
    texts = keyed(docs).select("text", "id").join(found, "id").select("text", "id", "runs")
    return marked.drop("lo", "c"), sorted_out(stretches(texts, size, gram, buckets, hot), size)


def suffix_digest(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    A null text is empty. Texts shorter than `size` lose nothing. Equal texts of `size` bytes or more lose all their
    bytes, repeated rows included. Ids are taken to be unique, but for repeated rows. A null doc_id is one of them.
    """
    marked, removed = _parts(docs, size, gram)
    cut = kept_bytes(docs, removed, size).select("id", "th", F.col("n_removed").alias("_n"), F.col("n_spans").alias("_s"), F.col("sha").alias("_sha")).dropDuplicates(["id", "th"])
    whole = F.col("copied") & (F.col("n_bytes") >= size)
    return marked.join(cut, ["id", "th"], "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("_s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"),
    )


def remaining(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id and the bytes that are left of each text, as a binary column (cuts can fall inside a character)."""
    marked, removed = _parts(docs, size, gram)
    cut = kept_bytes(docs, removed, size).select("id", "th", "kept").dropDuplicates(["id", "th"])
    whole = marked.where(F.col("copied") & (F.col("n_bytes") >= size)).select("id", "th", F.lit(b"").alias("kept")).distinct()
    new = cut.join(whole.select("id", "th"), ["id", "th"], "left_anti").unionByName(whole)
    own = keyed(docs).join(new, ["id", "th"], "left")
    return own.select("doc_id", F.coalesce("kept", F.coalesce("text", F.lit("")).cast("binary")).alias("kept"))
