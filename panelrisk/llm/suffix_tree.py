"""LM scoring with a probabilistic suffix tree over words.

States are contexts of up to DEPTH words. Words and longer sequences are counted over all training texts; a sequence is
known if it occurs LEAST times, at every size of the corpus. The next-word distribution of a context is smoothed: counts are
discounted, and the mass that this frees follows the distribution of the context's longest proper suffix, down to the add-half
distribution over single words. A context is a state if the log-likelihood that its distribution gains over that of its
suffix, on the training tokens after it, passes a divergence test. A token is scored in the longest state that ends before it.

No part of the tree is held in one place. Words are numbered first: chunks of texts ask buckets of words for their counts. Then
every token goes, with the words before it, to the bucket of the word before it: there all contexts that end in this word meet,
so that the bucket counts, tests and scores them alone, and only sums for each text come back. A context that occurs HOT times or
more would fill a bucket; its distribution is made by grouping and joining rows, and its tokens are dealt by one more word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrisk.llm import text as T
from panelrisk.llm.store import bucket_count, discard, in_fold, one_action, written
from panelrisk.llm.substring import planes, unplaned

DEPTH, LEAST, GAIN, DISCOUNT = 3, 2, 12.0, 0.5
#: Tokens of all texts for each bucket.
PER_BUCKET = 1_000_000
#: Training tokens after a context from which on it is spread over buckets.
HOT = 4_000_000
#: Tokens in a chunk, at most but for one piece.
CHUNK = 500_000
#: Tokens of a bucket that are worked on at a time, but for those of one context.
BLOCK = 1 << 18
#: Tokens are sent to the buckets in so many passes, which bounds what lies on disk at a time.
PASSES = 3
END = np.uint64(0x51ED270B0B1A3F29)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row and its end, and their rows."""
    data = T.LOWER[data]
    starts, ends, rows = T.spans(data, offsets, T.SPACED)
    n = len(offsets) - 1
    out, of = np.full(len(rows) + n, END, np.uint64), np.empty(len(rows) + n, np.int64)
    at = np.arange(len(rows)) + rows
    last = np.searchsorted(rows, np.arange(1, n + 1)) + np.arange(n)
    out[at], of[at], of[last] = T.stretch_hashes(data, starts, ends), rows, np.arange(n)
    return out, of


def packed(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, for `unpacked`."""
    return pa.compress(planes(x), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(raw: bytes, kind: type, n: int) -> np.ndarray:
    return unplaned(pa.decompress(raw, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


@dataclass
class Rules:
    """What the tree is built by; train and distinct are known after the words were counted."""

    depth: int
    least: int
    gain: float
    discount: float
    buckets: int
    hot: int
    train: int = 0
    distinct: int = 0

    @property
    def scale(self) -> float:
        return self.train + 0.5 * (self.distinct + 1)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows of plain values as a table of Spark's schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else ((),) * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _each(frame: DataFrame, f, schema: str) -> DataFrame:
    """The rows that f gives for each row of a frame, a dict of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _table(list(f(batch.slice(k, 1).to_pylist()[0])), schema).to_batches()

    return frame.mapInArrow(run, schema)


CHUNKS = "chunk long, doc_id array<long>, held array<boolean>, ends array<long>, n_words long, words binary, codes binary"
COUNTS = "bucket int, chunk long, n long, keys binary, counts binary"
NUMBERS = "chunk long, bucket int, n long, ids binary, counts binary, total long, positive long"
NUMBERED = "chunk long, doc_id array<long>, held array<boolean>, ends array<long>, known array<long>, base array<double>, n_words long, ids binary, counts binary, codes binary, marks binary, n_hot long, lead binary, best binary"
PAIRS = "chunk long, c long, w long, n long, p double"
PARTS = "bucket int, chunk long, n long, n_docs long, docs binary, sizes binary, marks binary, words binary, counts binary, n_hot long, lead binary, best binary"
SUMS = "chunk long, bucket int, n long, docs binary, sums binary"


def _chunks(docs: DataFrame) -> DataFrame:
    """Texts (doc_id, text, held) as chunks: the different words, ascending hashes, and the place of each token among them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, []

        def row() -> list[pa.RecordBatch]:
            ids, out, values, many = zip(*held, strict=True)
            words, codes = np.unique(np.concatenate(values), return_inverse=True)
            lists = pa.concat_arrays(ids).to_pylist(), pa.concat_arrays(out).to_pylist(), np.cumsum(np.concatenate(many))
            return _table([(chunk, *lists, len(words), packed(words), packed(codes.astype(np.uint32)))], CHUNKS).to_batches()

        size = 0
        for batch in batches:
            for lo, hi, data, offsets in T.pieces(batch.column(1)):
                values, rows = tokens(data, offsets)
                held.append((batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), values, np.bincount(rows, minlength=hi - lo)))
                size += len(values)
                if size > CHUNK:
                    yield from row()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from row()

    return docs.mapInArrow(cut, CHUNKS)


def _word_numbers(chunks: DataFrame, rules: Rules) -> DataFrame:
    """Numbers and training counts of the words of each chunk, by buckets of words.

    Numbers grow with rarity, and are above 0 for words that occur `least` times, 0 for others.
    """

    def ask(row: dict) -> Iterator[tuple]:
        words, ends = unpacked(row["words"], np.uint64, row["n_words"]), np.array(row["ends"], np.int64)
        train = np.repeat(~np.array(row["held"], bool), np.diff(np.r_[0, ends]))
        counts = np.bincount(unpacked(row["codes"], np.uint32, ends[-1]), weights=train, minlength=len(words)).astype(np.int64)
        bucket = ((words >> np.uint64(32)) * np.uint64(rules.buckets) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(rules.buckets + 1)).tolist()
        for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if y > x:
                yield b, row["chunk"], y - x, packed(words[x:y]), packed(counts[x:y])

    def add(table: pa.Table) -> pa.Table:
        asked = table.sort_by("chunk").to_pylist()
        keys, back = np.unique(np.concatenate([unpacked(r["keys"], np.uint64, r["n"]) for r in asked]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([unpacked(r["counts"], np.int64, r["n"]) for r in asked])).astype(np.int64)
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(keys))
        ids = np.where(counts >= rules.least, rank * rules.buckets + asked[0]["bucket"] + 1, 0)
        own = np.split(back, np.cumsum([r["n"] for r in asked])[:-1])
        totals = [(int(counts.sum()), int((counts > 0).sum()))] + [(0, 0)] * (len(asked) - 1)
        return _table([(r["chunk"], r["bucket"], r["n"], packed(ids[at]), packed(counts[at]), *t) for r, at, t in zip(asked, own, totals, strict=True)], NUMBERS)

    asked = _each(chunks.select("chunk", "held", "ends", "n_words", "words", "codes"), ask, COUNTS)
    return asked.groupBy("bucket").applyInArrow(add, NUMBERS)


def _numbered(chunks: DataFrame, numbers: DataFrame, rules: Rules) -> DataFrame:
    """Chunks with the numbers and counts of their words, and n_known and base_score of each text."""

    def number(own: pa.Table, answered: pa.Table) -> pa.Table:
        row, answers = own.to_pylist()[0], answered.sort_by("bucket").to_pylist()
        ids, counts = (np.concatenate([unpacked(r[c], np.int64, r["n"]) for r in answers]) for c in ("ids", "counts"))
        ends = np.array(row["ends"], np.int64)
        codes, rows = unpacked(row["codes"], np.uint32, ends[-1]), np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        known = np.bincount(rows, weights=(counts > 0)[codes], minlength=len(ends)).astype(np.int64)
        base = np.bincount(rows, weights=np.log10((counts + 0.5) / rules.scale)[codes], minlength=len(ends))
        return _table([(*(row[c] for c in ("chunk", "doc_id", "held", "ends")), known, base, len(ids), packed(ids), packed(counts), row["codes"], packed(np.zeros(len(codes), np.uint8)), 0, b"", b"")], NUMBERED)

    return chunks.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(number, NUMBERED)


class Tokens:
    """The tokens of a numbered chunk: words, their counts, the words before them, and what is known of their hot contexts.

    level: length of the hot contexts that are done. big: whether the sequence of the longest hot context and the token is itself
    a hot context of the tokens after. hot_lead: for tokens with hot contexts, in order, the probability after the longest of
    these; hot_best: after the longest of these that is a state, else of the single word. Words without number count
    as if they had probability 1 as single words.
    """

    def __init__(self, row: dict, rules: Rules):
        ids, counts = (unpacked(row[c], np.int64, row["n_words"]) for c in ("ids", "counts"))
        ids = ids.astype(np.uint32) if ids.max() < 2**32 else ids
        ends = np.array(row["ends"], np.int64)
        codes = unpacked(row["codes"], np.uint32, ends[-1])
        self.row, self.rules, self.n = row, rules, len(codes)
        self.doc = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(np.r_[0, ends]))
        self.train = ~np.array(row["held"], bool)[self.doc]
        self.inner = np.r_[False, self.doc[1:] == self.doc[:-1]]
        self.w, self.count = ids[codes], counts[codes]
        self.before, last = [], self.w
        for k in range(rules.depth):
            last = self.shifted(last) if not k else np.where(last > 0, self.shifted(last), last.dtype.type(0))
            self.before.append(last)
        marks = unpacked(row["marks"], np.uint8, self.n)
        self.level, self.big = marks >> 1, (marks & 1).astype(bool)
        lead, best = (unpacked(row[c], np.uint64, row["n_hot"]) for c in ("lead", "best"))
        self.hot_lead, self.hot_best = lead.view(float), (lead ^ best).view(float)
        self.place = np.cumsum(self.level > 0, dtype=np.int32) - 1 if row["n_hot"] else None

    def probability(self, at: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """hot_lead or hot_best of tokens, the probability of the single word where they have none."""
        p = np.where(self.w[at] > 0, (self.count[at] + 0.5) / self.rules.scale, 1.0)
        if self.place is not None:
            done = self.level[at] > 0
            p[done] = hot[self.place[at[done]]]
        return p

    def shifted(self, x: np.ndarray) -> np.ndarray:
        """What the token before has, within the text."""
        return np.where(self.inner, np.r_[x[:1], x[:-1]], x.dtype.type(0))

    def hot(self, k: int) -> np.ndarray:
        """Tokens after a hot context of k words."""
        known = (self.w > 0) & (self.count >= self.rules.hot) if k == 1 else (self.level == k - 1) & self.big
        return np.flatnonzero(self.shifted(known))

    def context(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hash of the k words before tokens."""
        h = T.mix(self.before[0][at].astype(np.uint64))
        for before in self.before[1:k]:
            h = T.mix(h * np.uint64(5) + before[at].astype(np.uint64))
        return h

    def pairs(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of hot context and word at tokens: contexts, words (ascending), and which one each token has."""
        c, w = self.context(k, at).view(np.int64), self.w[at].astype(np.int64)
        order = np.lexsort((w, c))
        new = np.r_[True, (c[order][1:] != c[order][:-1]) | (w[order][1:] != w[order][:-1])]
        back = np.empty(len(at), np.int64)
        back[order] = np.cumsum(new) - 1
        return c[order][new], w[order][new], back


def _pairs(numbered: DataFrame, rules: Rules, k: int) -> DataFrame:
    """chunk, c, w, n, p: hot contexts of k words and the words after them, with training counts and probabilities after the suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Tokens(batch.slice(i, 1).to_pylist()[0], rules)
                at = own.hot(k)
                if len(at):
                    c, w, back = own.pairs(k, at)
                    p = np.empty(len(c))
                    p[back] = own.probability(at, own.hot_lead)
                    n = np.bincount(back, weights=own.train[at], minlength=len(c)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), own.row["chunk"])), pa.array(c), pa.array(w), pa.array(n), pa.array(p)], names=["chunk", "c", "w", "n", "p"])

    return numbered.mapInArrow(run, PAIRS)


def _distributions(counts: DataFrame, rules: Rules) -> DataFrame:
    """c, w, n, p, state of hot contexts: smoothed probabilities, and whether the context passes the divergence test."""
    own = (F.col("w") > 0) & (F.col("n") >= rules.least)
    sums = counts.groupBy("c").agg(F.sum("n").alias("nc"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("seen"), F.count(F.when(own, 1)).alias("kinds"))
    share = F.when(own, (F.col("n") - rules.discount) / F.col("nc")).otherwise(0.0)
    rest = (F.col("nc") - F.col("seen") + rules.discount * F.col("kinds")) / F.col("nc")
    found = counts.join(sums, "c").select("c", "w", "n", F.col("p").alias("above"), (share + rest * F.col("p")).alias("p"))
    tests = found.groupBy("c").agg((F.sum(F.col("n") * F.log(F.col("p") / F.col("above"))) >= rules.gain).alias("state"))
    return found.join(tests, "c").select("c", "w", "n", "p", "state")


def _with_hot(numbered: DataFrame, looked: DataFrame, rules: Rules, k: int) -> DataFrame:
    """numbered with what was found of hot contexts of k words (chunk, c, w, n, p, state)."""

    def attach(own: pa.Table, found: pa.Table) -> pa.Table:
        t = Tokens(own.to_pylist()[0], rules)
        at = t.hot(k)
        if not len(at):
            return own
        c, w, n, p, state = (found[x].to_numpy() for x in ("c", "w", "n", "p", "state"))
        order, (_, _, back) = np.lexsort((w, c)), t.pairs(k, at)
        at_pair = order[back]
        now = np.where(state[at_pair], p[at_pair], t.probability(at, t.hot_best))
        lead, best = (np.empty(t.n) for _ in range(2))
        done = np.flatnonzero(t.level > 0)
        lead[done], best[done] = t.hot_lead, t.hot_best
        lead[at], best[at], t.level[at], t.big[:] = p[at_pair], now, k, False
        t.big[at] = (n[at_pair] >= rules.hot) & (t.w[at] > 0)
        done = np.flatnonzero(t.level > 0)
        lead, best = lead[done].view(np.uint64), best[done].view(np.uint64)
        return _table([(*(t.row[f.split()[0]] for f in NUMBERED.split(", ")[:-4]), packed((t.level << 1 | t.big).astype(np.uint8)), len(done), packed(lead), packed(lead ^ best))], NUMBERED)

    return numbered.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(attach, NUMBERED)


def _hot_contexts(numbered: DataFrame, rules: Rules) -> DataFrame:
    """numbered, with all hot contexts done, from the shortest to the longest; most corpora have few."""
    for k in range(1, rules.depth + 1):
        pairs = written(_pairs(numbered, rules, k), "hot-pairs")
        if pairs.isEmpty():
            break
        counts = written(pairs.groupBy("c", "w").agg(F.sum("n").alias("n"), F.max("p").alias("p")), "hot-counts")
        looked = pairs.select("chunk", "c", "w").join(_distributions(counts, rules), ["c", "w"])
        more = written(_with_hot(numbered, looked, rules, k), "numbered")
        for done in (numbered, pairs, counts):
            discard(done)
        numbered = more
    return numbered


def _parts(numbered: DataFrame, rules: Rules, turn: int, turns: int) -> DataFrame:
    """The tokens of chunks by bucket: of the shortest context before them that is not hot, or of any if nothing is left to do."""

    def deal(row: dict) -> Iterator[tuple]:
        t = Tokens(row, rules)
        at = np.flatnonzero((t.before[0] > 0) if rules.depth else np.zeros(t.n, bool))
        level = t.level[at]
        key = np.full(len(at), row["chunk"]).astype(np.uint64)
        for k in range(rules.depth):
            own = np.flatnonzero((level == k) & (t.before[k][at] > 0))
            key[own] = t.context(k + 1, at[own])
        bucket = (T.mix(key + np.uint64(1)) % np.uint64(rules.buckets)).astype(np.int64)
        some = np.flatnonzero(bucket % turns == turn)
        some = some[np.argsort(bucket[some].astype(np.uint16) if rules.buckets <= 65_536 else bucket[some], kind="stable")]
        at, bucket = at[some], bucket[some]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(at) else []
        for x, y in zip(edges, [*edges[1:], len(at)] if edges else [], strict=True):
            own = at[x:y]
            first = np.flatnonzero(np.r_[True, t.doc[own][1:] != t.doc[own][:-1]])
            docs, sizes = t.doc[own][first].astype(np.uint32), np.diff(np.r_[first, len(own)]).astype(np.uint32)
            hot = own[t.level[own] > 0]
            lead, best = (x[t.place[hot]].view(np.uint64) if len(hot) else np.zeros(0, np.uint64) for x in (t.hot_lead, t.hot_best))
            words = np.concatenate([t.w[own], *(b[own] for b in t.before)]).astype(np.int64)
            marks = (t.level[own] << 1 | t.train[own]).astype(np.uint8)
            yield int(bucket[x]), row["chunk"], len(own), len(docs), packed(docs), packed(sizes), packed(marks), packed(words), packed(t.count[own]), len(lead), packed(lead), packed(lead ^ best)

    return _each(numbered.drop("doc_id", "known", "base"), deal, PARTS)


def _narrow(words: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits that are equal, and 0, where the given ones are."""
    if words.dtype == np.uint32 or not words.size or words.max() < 2**32:
        return words.astype(np.uint32, copy=False)
    return np.unique(np.r_[0, words.reshape(-1)], return_inverse=True)[1][1:].astype(np.uint32).reshape(words.shape)


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two numbers below 2**32 in one."""
    return a.astype(np.uint64) << np.uint64(32) | b


def _level(group: np.ndarray, w: np.ndarray, use: np.ndarray, train: np.ndarray, p: np.ndarray, best: np.ndarray, rules: Rules) -> None:
    """Replace p and best, by those after the contexts of one more word, where `use` says so.

    group: number below 2**32 of the context of each token; all training tokens after a context that is used are there.
    """
    keys, pair = np.unique(_two(group, w), return_inverse=True)
    above, n = np.empty(len(keys)), np.bincount(pair, weights=train)
    above[pair] = p
    context = keys >> np.uint64(32)
    of = np.cumsum(np.r_[False, context[1:] != context[:-1]])
    own = (n >= rules.least) & ((keys & np.uint64(0xFFFFFFFF)) > 0)
    nc = np.bincount(of, weights=n)
    rest = (nc - np.bincount(of, weights=n * own) + rules.discount * np.bincount(of, weights=own)) / np.maximum(nc, 1)
    q = np.where(own, (n - rules.discount) / np.maximum(nc[of], 1), 0.0) + rest[of] * above
    q = np.where(nc[of] >= rules.least, q, above)
    state = (nc >= rules.least) & (np.bincount(of, weights=n * np.log(q / above)) >= rules.gain)
    np.copyto(p, q[pair], where=use)
    np.copyto(best, p, where=use & state[of][pair])


def _longer(words: np.ndarray, level: np.ndarray, train: np.ndarray, p: np.ndarray, best: np.ndarray, rules: Rules) -> np.ndarray:
    """best after all contexts of two words or more that are not hot, of tokens that share these; p: after those of one."""
    order = np.lexsort(words[1:][::-1])
    words, level, train, p, out = words[:, order], level[order], train[order], p[order], best[order]
    new = np.zeros(len(p), bool)
    for k in range(1, rules.depth + 1):
        new[1:] |= words[k][1:] != words[k][:-1]
        if k > 1:
            _level(np.cumsum(new), words[0], (level < k) & (words[k] > 0), train, p, out, rules)
    best = np.empty(len(out))
    best[order] = out
    return best


def _scored(table: pa.Table, rules: Rules) -> pa.Table:
    """Sums by text of log10 of the scored over the single-word probability of the tokens of one bucket.

    Contexts of two words or more are worked on in blocks.
    """
    parts = table.sort_by("chunk").to_pylist()
    roles = (unpacked(r["words"], np.int64, (rules.depth + 1) * r["n"]).reshape(rules.depth + 1, -1) for r in parts)
    words = _narrow(np.concatenate([x.astype(np.uint32) if x.max() < 2**32 else x for x in roles], axis=1))
    marks = np.concatenate([unpacked(r["marks"], np.uint8, r["n"]) for r in parts])
    level, train = marks >> 1, (marks & 1).astype(np.float32)
    single = np.concatenate([unpacked(r["counts"], np.int64, r["n"]) for r in parts])
    single = np.where(words[0] > 0, (single + 0.5) / rules.scale, 1.0)
    p, best = single.copy(), single.copy()
    if level.any():
        lead = np.concatenate([unpacked(r["lead"], np.uint64, r["n_hot"]) for r in parts])
        p[level > 0], best[level > 0] = lead.view(float), (lead ^ np.concatenate([unpacked(r["best"], np.uint64, r["n_hot"]) for r in parts])).view(float)
    _level(words[1], words[0], (level < 1) & (words[1] > 0), train, p, best, rules)
    if rules.depth > 1:
        block = (T.mix(_two(words[1], words[2])) % np.uint64(-(-len(marks) // BLOCK))).astype(np.uint16)
        order = np.argsort(block, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            best[at] = _longer(words[:, at], level[at], train[at], p[at], best[at], rules)
    best = np.log10(best, out=best) - np.log10(single, out=single)
    out = []
    for r, x in zip(parts, np.split(best, np.cumsum([r["n"] for r in parts])[:-1]), strict=True):
        per_doc = unpacked(r["sizes"], np.uint32, r["n_docs"]).astype(np.int64)
        out.append((r["chunk"], r["bucket"], r["n_docs"], r["docs"], packed(np.add.reduceat(x, np.cumsum(per_doc) - per_doc))))
    return _table(out, SUMS)


def lm_scores(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN, discount: float = DISCOUNT, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Texts of the fold crc32(doc_id) mod 5 = 1 are scored, but not learned from; those with a null id are learned from. A null
    text is empty and has its end alone. Repeated rows are learned from and scored each. A text of any length is one
    row of a chunk. Without training texts every token is unknown and both scores are log10 of 1. Other columns are left out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), in_fold(1).alias("held"))
    chunks = written(_chunks(docs), "token-chunks")
    n = chunks.agg(F.coalesce(F.sum(F.element_at("ends", -1)), F.lit(0))).first()[0]
    rules = Rules(depth, least, gain, discount, bucket_count(spark, n, PER_BUCKET), hot)
    with one_action(spark):
        numbers = written(_word_numbers(chunks, rules), "word-numbers")
        rules.train, rules.distinct = numbers.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("positive"), F.lit(0))).first()
        numbered = written(_numbered(chunks, numbers, rules), "numbered")
        discard(chunks)
        discard(numbers)
        numbered = _hot_contexts(numbered, rules)
        sums = None
        for turn in range(PASSES):
            more = written(_parts(numbered, rules, turn, PASSES).groupBy("bucket").applyInArrow(lambda table: _scored(table, rules), SUMS), "text-sums")
            sums = more if sums is None else sums.unionAll(more)

    def finish(own: pa.Table, answered: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        score = np.array(row["base"], float)
        for r in answered.sort_by("bucket").to_pylist():
            score[unpacked(r["docs"], np.uint32, r["n"])] += unpacked(r["sums"], np.float64, r["n"])
        sizes, train = np.diff(np.r_[0, row["ends"]]), np.full(len(score), rules.train, np.int64)
        return pa.table(
            [pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(row["known"], pa.int64()), pa.array(train), pa.array(row["base"], pa.float64()), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    texts = numbered.select("chunk", "doc_id", "held", "ends", "known", "base")
    return texts.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
