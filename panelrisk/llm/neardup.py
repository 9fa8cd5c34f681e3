"""MinHash near-dedup with ProbMinHash over weighted word shingles.

The weight of a shingle (five words) is how often the text holds it. Each shingle meets the registers of a
sketch in random order at the times of a Poisson process of its weight; a register keeps the shingle that comes
first, so that two sketches agree in a register with the probability Jaccard similarity of the weights. A
shingle is dropped as soon as its next time is later than every register's. Bands of registers bring candidates
together; the exact probability Jaccard of the texts decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrisk.llm import text as T
from panelrisk.llm.components import components
from panelrisk.llm.store import keyed, keyed_rows, own_columns, private, written

SHINGLE, SIMILAR = 5, 0.8
#: Bands of registers. A pair of similarity 0.8 shares a band but once in 1,500 cases not.
BANDS, ROWS = 24, 6
#: A prime, for the order in which a shingle meets the registers; the first BANDS * ROWS are used.
REGISTERS = 149
#: Texts of up to so many different shingles meet all registers at once.
FEW = 32
#: Shingles of such texts that are drawn for together, which bounds the memory whatever the lengths of texts.
TOGETHER = 8192
#: Texts and words of a bucket in one block on average, and how much lower than the similarity the share of equal registers may be (3.6 standard deviations).
BLOCK, BLOCK_WORDS, SLACK = 256, 262_144, 0.12
#: Counters of how frequent shingles are, whatever their number.
COUNTERS = 1 << 20
#: Order of keys that are hashes of shingles, as in `by_rarity`: there, hashes are unsigned.
RARE_FIRST = ["often", "unsigned"]
#: The most bits that tell which texts may be candidates (16 MB).
MOST_BITS = 1 << 27


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes and counts of different shingles; number of words and hash of all words by row.

    A text of one to k - 1 words is one shingle.
    """
    n = len(offsets) - 1
    starts, ends, rows = T.spans(data, offsets, T.SPACED)
    words = T.stretch_hashes(data, starts, ends)
    first = np.searchsorted(rows, np.arange(n + 1))
    size, sums = np.diff(first), T.prefix(words)
    whole = T.mix(T.rolled(sums, first[:-1], first[1:]) ^ size.astype(np.uint64))
    grams = T.window_hashes(words, k)
    own = rows[: len(grams)]
    inside = rows[k - 1 :] == own
    short = np.flatnonzero((size > 0) & (size < k))
    of, h = np.concatenate([own[inside], short]), np.concatenate([grams[inside], whole[short]])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, np.int64)
    return of[new], h[new], np.diff(np.r_[new, len(h)]), size, whole


def sketches(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Registers (shingle hashes) of n texts; rows without shingles hold zeros."""
    p = REGISTERS
    time, kept = np.full(n * p, np.inf), np.zeros(n * p, np.uint64)
    seed = T.mix(hashes)
    stride, begin = (seed % np.uint64(p - 1)).astype(np.int64) + 1, ((seed >> np.uint64(32)) % np.uint64(p)).astype(np.int64)
    count = np.bincount(rows, minlength=n)

    def waits(which: np.ndarray, j: np.ndarray) -> np.ndarray:
        u = (T.mix(seed[which] + j.astype(np.uint64) * np.uint64(T.MULT)) >> np.uint64(11)).astype(np.float64)
        return -np.log((u + 0.5) * 2.0**-53) / (weights[which] * (p - j))

    def put(which: np.ndarray, j: np.ndarray, t: np.ndarray) -> None:
        at = rows[which] * p + (begin[which] + j * stride[which]) % p
        np.minimum.at(time, at, t)
        first = t == time[at]
        kept[at[first]] = hashes[which[first]]

    few = np.flatnonzero(count[rows] <= FEW)
    for k in range(0, len(few), TOGETHER):
        own = few[k : k + TOGETHER]
        every, turn = np.repeat(own, p), np.tile(np.arange(p), len(own))
        put(every, turn, np.cumsum(waits(every, turn).reshape(-1, p), axis=1).reshape(-1))
    live, t, j = np.flatnonzero(count[rows] > FEW), None, 0
    t = np.zeros(len(live))
    while len(live) and j < p:
        turn = np.full(len(live), j)
        t = t + waits(live, turn)
        if j:
            latest = time.reshape(n, p).max(axis=1)
            on = t <= latest[rows[live]]
            live, t, turn = live[on], t[on], turn[on]
        put(live, turn, t)
        j += 1
    return kept.reshape(n, p)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """BANDS keys of each row of registers."""
    own = registers[:, : BANDS * ROWS].reshape(len(registers), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(own), 1))
    for k in range(ROWS):
        key = T.mix(key * np.uint64(0x2545F4914F6CDD1D) + own[:, :, k])
    return key


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over shared shingles i of 1 / sum over j of max(a_j / a_i, b_j / b_i); a, b: sorted hashes and counts.

    Shingles with the same two counts add the same, so that the work is that of the pairs of counts that occur.
    """
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = b[0][at] == a[0]
    n = int(shared.sum())
    if not n or (a[1].max() == 1 and b[1].max() == 1):
        return n / (len(a[0]) + len(b[0]) - n)
    rest = np.ones(len(b[0]), bool)
    rest[at[shared]] = False
    x = np.concatenate([a[1], np.zeros(rest.sum(), np.int64)])
    y = np.concatenate([np.where(shared, b[1][at], 0), b[1][rest]])
    kinds, many = np.unique(x * (int(y.max()) + 1) + y, return_counts=True)
    x, y = (v.astype(np.float64) for v in np.divmod(kinds, int(y.max()) + 1))
    own = (x > 0) & (y > 0)
    total = (np.maximum(x[None, :] / x[own][:, None], y[None, :] / y[own][:, None]) * many).sum(axis=1)
    return float((many[own] / total).sum())


def _sketched(docs: DataFrame) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column(1), 2 * T.PIECE):
                n = hi - lo
                rows, h, weights, size, whole = shingles(data, offsets)
                keys = band_keys(sketches(rows, h, weights, n))
                some = size > 0
                offsets_ = np.r_[0, np.cumsum(np.where(some, BANDS, 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(n)), *(batch.column(c).slice(lo, n) for c in (0, 2, 3)), pa.array(size), pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets_), pa.array(keys[some].reshape(-1).view(np.int64)))],
                    names=["uid", "doc_id", "id", "th", "n_words", "whole", "keys"],
                )
                uid += n

    return docs.mapInArrow(sketch, "uid long, doc_id long, id long, th long, n_words long, whole long, keys array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """a, b of the pairs whose exact similarity is `similar` or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                own = []
                for c in (2, 3):
                    name = (c, batch.column(c - 2)[k].as_py())
                    if c == 2 and last[0] == name:
                        own.append(last[1])
                        continue
                    data, offsets = T.buffers(batch.column(c).slice(k, 1))
                    _, h, count, _, _ = shingles(data[offsets[0] : offsets[1]], offsets - offsets[0])
                    own.append((h, count))
                    last = (name, own[-1]) if c == 2 else last
                if min(len(own[0][0]), len(own[1][0])) and probability_jaccard(*own) >= similar - 1e-12:
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    with_a = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("x")), "a")
    with_b = with_a.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return with_b.mapInArrow(verify, "a long, b long")


def _with_shingles(texts: DataFrame) -> DataFrame:
    """uid, component, hashes and counts of different shingles of uid, component, text."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column(2), 2 * T.PIECE):
                rows, h, weights, _, _ = shingles(data, offsets)
                at = np.searchsorted(rows, np.arange(hi - lo + 1))
                cells = [[v[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for v in (h, weights.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), *(pa.array(c, pa.binary()) for c in cells)], names=["uid", "component", "hashes", "counts"])

    return texts.select("uid", "component", "text").mapInArrow(listed, "uid long, component long, hashes binary, counts binary")


def _frequencies(own: DataFrame) -> np.ndarray:
    """COUNTERS numbers of occurrences of shingles in different texts, by the last bits of their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            found += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        slots = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(found[slots])], names=["slot", "n"])

    summed = own.select("hashes").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return often


def by_rarity(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Order of shingles from rare to frequent, the same in every text."""
    return np.lexsort((hashes, often[(hashes % np.uint64(COUNTERS)).astype(np.int64)]))


def rare_shingles(hashes: np.ndarray, counts: np.ndarray, often: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """The rarest shingles of a text, with 1 - similar of its weight and one more.

    Shingles that two texts share hold at least their similarity of the weight of each. Those that are rarer than
    the rarest shared one hold the rest at most, so that both texts have it among their rarest.
    """
    order = by_rarity(hashes, often)
    before = np.cumsum(counts[order]) - counts[order]
    return hashes[order[: np.searchsorted(before, (1 - similar + 1e-9) * counts.sum(), side="right")]]


def _before(hashes: np.ndarray, key: np.uint64, often: np.ndarray) -> set[int]:
    """The shingles that are rarer than key, or as rare and of a smaller hash."""
    n = often[(hashes % np.uint64(COUNTERS)).astype(np.int64)]
    own = often[int(key) % COUNTERS]
    return set(hashes[(n < own) | ((n == own) & (hashes < key))].tolist())


def _split(own: DataFrame, often: Broadcast, similar: float) -> DataFrame:
    """key, uid, component, n_words, often, unsigned: texts that have one of their rarest shingles in common, where they are in different components.

    Of shingles that the same texts hold, the rarest (RARE_FIRST) is kept.
    """

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            hashes, counts = ([np.frombuffer(v, kind) for v in batch.column(c).to_pylist()] for c, kind in ((2, np.uint64), (3, np.int64)))
            keys = [rare_shingles(h, n, often.value, similar) for h, n in zip(hashes, counts, strict=True)]
            of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            words = np.array([len(h) for h in hashes])
            every = np.concatenate(keys)
            times = often.value[(every % np.uint64(COUNTERS)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(words[of]), pa.array(times)], names=["key", "uid", "component", "n_words", "often"])

    rows = own.select("uid", "component", "hashes", "counts").mapInArrow(rarest, "key long, uid long, component long, n_words long, often long")
    return _of_different_texts(rows.withColumn("unsigned", F.col("key").bitwiseXOR(F.lit(-(2**63)))), RARE_FIRST)


def _compared(parts: DataFrame, texts: DataFrame, similar: float, often: Broadcast | None = None) -> DataFrame:
    """a, b: links between texts of one bucket and different components, by the meetings of blocks (`_in_blocks`) of the buckets.

    Of two blocks one link is kept for any two components. A pair is compared in the bucket of the first band that it
    shares, or, where buckets are those of rare shingles (often is given), of the rarest shingle; and in no other.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for k in range(batch.num_rows):
                band, lo, hi = (batch.column(c)[k].as_py() for c in (0, 2, 3))
                key, all_ = np.int64(batch.column(1)[k].as_py()).view(np.uint64), batch.column(4)[k].values
                data, offsets = T.buffers(all_.field("text"))
                rows, h, weights, _, _ = shingles(data[offsets[0] : offsets[-1]], offsets - offsets[0])
                at, drawn = np.searchsorted(rows, np.arange(len(all_) + 1)), sketches(rows, h, weights, len(all_))
                sides = [np.flatnonzero(all_.field("part").to_numpy() == side) for side in (lo, hi)]
                registers = [drawn[own] for own in sides]
                component, uid = ([all_.field(c).to_numpy()[own] for own in sides] for c in ("component", "uid"))
                equal = np.zeros((len(uid[0]), len(uid[1])), np.int16)
                for p, q in zip(registers[0].T, registers[1].T, strict=True):
                    equal += p[:, None] == q[None, :]
                r, c = np.nonzero((equal >= (similar - SLACK) * REGISTERS) & (component[0][:, None] != component[1][None, :]))
                if often is None:
                    shared = (registers[0][r] == registers[1][c])[:, : BANDS * ROWS].reshape(len(r), BANDS, ROWS).all(axis=2)
                    own_ = shared.argmax(axis=1) == band
                    r, c = r[own_], c[own_]
                texts_ = [[(h[at[i] : at[i + 1]], weights[at[i] : at[i + 1]]) for i in own.tolist()] for own in sides]
                if often is not None and len(r):
                    rarer = [[_before(h_, key, often.value) for h_, _ in side] for side in texts_]
                met: set[tuple[int, int]] = set()
                for i, j in zip(r.tolist(), c.tolist(), strict=True):
                    two = int(component[0][i]), int(component[1][j])
                    if two in met:
                        continue
                    if often is not None and not rarer[0][i].isdisjoint(rarer[1][j]):
                        continue
                    if probability_jaccard(texts_[0][i], texts_[1][j]) >= similar - 1e-12:
                        met.add(two)
                        out[0].append(int(uid[0][i]))
                        out[1].append(int(uid[1][j]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    meetings = parts.join(texts.select("uid", "text"), "uid").groupBy("band", "key", "lo", "hi").agg(F.collect_list(F.struct("part", "uid", "component", "text")).alias("x"))
    return meetings.mapInArrow(compare, "a long, b long")


def _blocks(size: Column, words: Column) -> Column:
    return F.ceil(F.greatest(size / BLOCK, words / BLOCK_WORDS)).cast("long")


def _in_blocks(placed: DataFrame) -> DataFrame:
    """placed (key, uid, component, n_words) with part (block) and one row for each meeting lo, hi of two blocks of the key that the text takes part in.

    A key of more than one block has blocks of its largest component and blocks of all others. The former are not compared with one another, so that the
    texts of one large component meet each block of the few others once.
    """
    sums = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    keys = sums.groupBy("key").agg(F.sum("n").alias("size"), F.sum("w").alias("words"), F.max(F.struct("n", "component", "w")).alias("m"))
    several = _blocks(F.col("size"), F.col("words")) > 1
    keys = keys.select(
        "key", F.when(several, F.col("m.component")).alias("main"),
        F.when(several, _blocks(F.col("m.n"), F.col("m.w"))).otherwise(0).alias("mains"),
        F.when(several, _blocks(F.col("size") - F.col("m.n"), F.col("words") - F.col("m.w"))).otherwise(1).alias("others"),
    )
    rows = placed.join(keys, "key").withColumn("main", F.coalesce(F.col("component") == F.col("main"), F.lit(False)))
    rows = rows.withColumn("part", F.when(F.col("main"), F.pmod(F.xxhash64("uid"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("uid"), F.col("others"))))
    met = rows.withColumn("with", F.explode(F.sequence(F.when(F.col("main"), F.col("mains")).otherwise(F.lit(0).cast("long")), F.col("mains") + F.col("others") - 1)))
    return met.withColumn("lo", F.least("part", "with")).withColumn("hi", F.greatest("part", "with")).drop("with", "main", "mains", "others")


def _of_different_texts(rows: DataFrame, first: list[str]) -> DataFrame:
    """rows (key, uid, component) of the keys whose texts are in different components; of keys with the same texts, the least by `first`.

    A pair of such texts has all these keys in common, and is compared for the first of them alone.
    """
    order = F.struct(*first, "key")
    ends = [F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64("uid", F.lit(k))).alias(f"h{k}") for k in (0, 1))]
    sets = rows.groupBy("key").agg(*ends, F.min("component").alias("c0"), F.max("component").alias("c1"), F.min(order).alias("order")).where("c0 < c1")
    return rows.join(sets.groupBy("n", "h0", "h1").agg(F.min("order").alias("order")).select("order.key"), "key")


def _linked_inside(placed: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """a, b: texts of one bucket and different components with similarity `similar` or more.

    Texts are compared block by block, first by their sketches and then exactly, so that only links become rows; with the leader of
    their bucket they were compared before. Texts of buckets of more than one block meet by their rarest shingles instead: what most
    texts of such a bucket hold brings none of them together.
    """
    parts = placed.withColumn("parts", _blocks(F.col("size"), F.col("words")))
    small = written(_of_different_texts(parts.where("parts = 1 AND uid <> leader"), ["band"]), "compared-buckets")
    needed = small.select("uid").distinct()
    alone = small.select("key", "band", "uid", "component", *(F.lit(0).alias(c) for c in ("part", "lo", "hi")))
    links = _compared(alone, _held(texts, needed, ("uid",)).join(needed, "uid"), similar)
    crowded = parts.where("parts > 1").select("uid", "component").distinct()
    crowd = written(_held(texts, crowded, ("uid",)).join(crowded, "uid"), "crowded")
    own = written(_with_shingles(crowd), "crowded-texts")
    often = placed.sparkSession.sparkContext.broadcast(_frequencies(own))
    split = written(_split(own, often, similar), "rare-shingles")
    return links.unionAll(_compared(_in_blocks(split).withColumn("band", F.lit(-1)), crowd, similar, often))


def _held(docs: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("id", "th")) -> DataFrame:
    """text and keys (longs) of docs without most of the rows whose keys wanted lacks, and with all that it holds.

    One bit stands for each hash of the keys, in 16 bits a row of wanted and MOST_BITS at most, so that texts which no join needs are not shuffled for it.
    """
    bits = min(MOST_BITS, 1 << max(10, (16 * wanted.count()).bit_length()))
    slot = F.pmod(F.xxhash64(*keys), F.lit(bits))
    words = wanted.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("set")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["set"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((shared.value[at // 64] >> (at % 64)) & 1 == 1)).select(["text", *keys])

    return docs.select("text", *keys, slot.alias("slot")).mapInArrow(keep, ", ".join(["text string", *(f"{k} long" for k in keys)]))


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, id, th, class_id, class_size, kept of every row of docs.

    A class holds what links join: equal sequences of words, and texts of similarity `similar` or more that share a
    band. class_id is its least doc_id, kept marks one row of it (the least doc_id; of rows with that id, one).
    Texts without words are alone; rows with equal doc_id are separate documents; a null doc_id counts as the largest.

    In every bucket of a band all texts are compared to one of them first, the one that shares most buckets with others.
    Where that leaves more than one component, all texts of the bucket that are in different ones are compared in blocks, by sketches
    and, where these are close, exactly, in one of the buckets that hold the same texts; in buckets of more than one block, only texts that have one of their rarest shingles in common,
    which any two of that similarity have. A large group of copies so makes about a row for each copy.
    """
    table = written(_sketched(keyed(docs)), "sketches")
    same = table.where("n_words > 0").groupBy("whole", "n_words").agg(F.min("uid").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    copies = written(table.select("uid", "whole", "n_words").join(same, ["whole", "n_words"]).where("uid <> m").select(F.col("uid").alias("a"), F.col("m").alias("b")), "copies")
    firsts = table.join(copies.select(F.col("a").alias("uid")), "uid", "left_anti")
    members = firsts.select("uid", "n_words", F.posexplode("keys").alias("band", "key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n_words").alias("words")).where("size > 1")
    inside = written(members.drop("n_words").join(buckets, "key"), "buckets")
    weight = inside.groupBy("uid").agg(F.sum("size").alias("weight"))
    leaders = inside.join(weight, "uid").groupBy("key").agg(F.max(F.struct("weight", (-F.col("uid")).alias("minus"))).alias("m")).select("key", (-F.col("m.minus")).alias("leader"))
    inside = written(inside.join(leaders, "key"), "led-buckets")
    pairs = inside.where("uid <> leader").select(F.col("leader").alias("a"), F.col("uid").alias("b")).distinct()
    wanted = written(inside.select("uid").distinct().join(table.select("uid", "id", "th"), "uid"), "candidates")
    texts = written(_held(keyed(docs), wanted).dropDuplicates(["id", "th"]).join(wanted, ["id", "th"]).select("uid", "text"), "candidate-texts")
    links = written(_verified(pairs, texts, similar), "links")
    joined = components(links)
    placed = inside.join(joined.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
    placed = written(placed.join(open_, "key").select("key", "band", "uid", "leader", "component", "size", "words"), "open-buckets")
    rest = _linked_inside(placed, texts, similar)
    classes = components(written(links.unionAll(rest).unionAll(copies), "all-links"))
    sized = table.select("uid", "doc_id", "id", "th").join(classes.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    least = sized.groupBy("component").agg(F.min(F.struct("id", "uid", "doc_id")).alias("least"), F.count(F.lit(1)).alias("class_size"))
    return sized.join(least, "component").select("doc_id", "id", "th", F.col("least.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("least.uid")).alias("kept"))


def neardup_digest(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, class_size, kept of every row of docs."""
    return near_duplicates(docs, similar).select("doc_id", "class_id", "class_size", "kept")


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of docs without those that are near copies of a kept one, with their columns as they are.

    Of rows that are equal in doc_id and text, one stays, whichever.
    """
    own, i, t = keyed_rows(docs)
    one = private(own, "_one")
    gone = near_duplicates(docs, similar).groupBy("id", "th").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1").select(F.col("id").alias(i), F.col("th").alias(t), F.col("kept").alias(one))
    marked = own.join(gone, [i, t], "left")
    once = marked.where(F.col(one)).dropDuplicates([i, t])
    return marked.where(F.col(one).isNull()).unionAll(once).select(*own_columns(docs))
