"""Cross-tokenizer alignment by interval coalescing.

Tokens of two tokenizers over one text are byte intervals. All of them, of a batch of texts that lie one after the other,
are sorted by start; the running maximum of their ends is accumulated, and a group breaks where a start reaches it.
Overlaps expand within groups. Each worker encodes each distinct chunk of text once, with either tokenizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrisk.llm import text as T
from panelrisk.llm.encode import Encoder, _printable_bytes, _visible, default_tokenizer
from panelrisk.llm.store import written

MARK = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Exact(Encoder):
    """An encoder that knows the bytes of its tokens, and which chunks they give back."""

    def _learn(self, token_bytes: list[bytes]) -> None:
        self.token_bytes = token_bytes
        self.widths = np.fromiter(map(len, token_bytes), np.int64, len(token_bytes))
        if not len(self.widths):
            raise ValueError("the vocabulary is empty")

    def forget(self) -> None:
        super().forget()
        self.exact = np.ones(1 << 16, bool)

    def _add(self, keys: np.ndarray, chunks: list[str]) -> np.ndarray:
        entries = super()._add(keys, chunks)
        while self.n > len(self.exact):
            self.exact = np.concatenate([self.exact, np.ones_like(self.exact)])
        for k, chunk in zip(entries.tolist(), chunks, strict=True):
            ids = self.ids[self.offsets[k] : self.offsets[k + 1]].tolist()
            self.exact[k] = b"".join(map(self.token_bytes.__getitem__, ids)) == chunk.encode()
        return entries

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, the row of each, and the rows whose tokens do not give back their bytes (in those, ids are of no use)."""
        if self.n > 3_000_000:
            self.forget()
        entries, rows = self._entries(data, offsets)
        begin = self.offsets[entries]
        sizes = self.offsets[entries + 1] - begin
        total = np.cumsum(sizes)
        ids = self.ids[np.repeat(begin - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)]
        wrong = np.zeros(len(offsets) - 1, bool)
        wrong[rows[~self.exact[entries]]] = True
        return ids, np.repeat(rows, sizes), wrong


class ByteEncoder(_Exact):
    """Byte-level BPE, with the strings of special tokens as plain text."""

    def __init__(self, path: str):
        super().__init__(path, plain=True)
        back = {c: b for b, c in self.table.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocabulary.values()) + 1)
        for name, k in vocabulary.items():
            names[k] = name
        self._learn([bytes(back[c] for c in x) if all(c in back for c in x) else x.encode() for x in names])


class PieceEncoder(_Exact):
    """SentencePiece BPE that adds a space before a text; texts are given with that space.

    No piece holds a space or a line end after another character (which is tried for the vocabulary given; else texts are not
    cut), so merges never cross the places before a space that follows another character, or before a line end.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model, self.table = SentencePieceProcessor(model_file=path), _printable_bytes()
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.cuttable = not any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in pieces)
        self.space = self.model.piece_to_id(MARK)
        self._learn([bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)])
        self.forget()

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        if self.cuttable:
            cut[1:-1] = ((data[1:] == 0x20) & (data[:-1] != 0x20)) | (data[1:] == 0x0A)
        return cut

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        """The library adds a space before each chunk: it takes the place of the one there, or is left out before a line end."""
        found = self.model.encode([c[1:] if c[:1] == " " else c for c in chunks], num_threads=1)
        for k, c in enumerate(chunks):
            if c == " ":
                found[k] = [self.space]
            elif c[:1] != " ":
                found[k] = found[k][1:] if found[k][:1] == [self.space] else []  # then the chunk is not given back
        return found


_own: dict[tuple[str, str], tuple[ByteEncoder, PieceEncoder]] = {}


def _encoders(a: str, b: str) -> tuple[ByteEncoder, PieceEncoder]:
    if (a, b) not in _own:
        _own[a, b] = ByteEncoder(a), PieceEncoder(b)
    return _own[a, b]


@dataclass
class Aligned:
    """Tokens of some rows: ids, the row and group of each; overlapping pairs as places of tokens; groups in order of the text."""

    rows: int
    exact: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_row: np.ndarray
    b_row: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_row: np.ndarray
    pair_a: np.ndarray
    pair_b: np.ndarray
    together: np.ndarray


def coalesced(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each interval of a and of b, and the number of groups; groups share no byte."""
    starts, ends = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    kinds = np.repeat(np.array([0, 1], np.int8), [len(a_start), len(b_start)])
    order = np.lexsort((kinds, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.zeros(len(starts), np.int64)
    breaks = starts[order][1:] >= reach[:-1]
    group[order[1:]] = np.cumsum(breaks)
    return group[: len(a_start)], group[len(a_start) :], int(breaks.sum()) + 1 if len(starts) else 0


def overlaps(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an interval of a and one of b that share a byte; both are in order and disjoint among themselves."""
    first, last = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")
    many = last - first
    total = np.cumsum(many)
    return np.repeat(np.arange(len(a_start)), many), np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - many - first, many)


def align(data: np.ndarray, offsets: np.ndarray, first: ByteEncoder, second: PieceEncoder) -> Aligned:
    """Rows whose tokens, of either tokenizer, do not give back their bytes have no tokens."""
    n = len(offsets) - 1
    a, a_row, a_wrong = first.tokens(data, offsets)
    b, b_row, b_wrong = second.tokens(data, offsets)
    wrong = a_wrong | b_wrong
    if wrong.any():
        keep_a, keep_b = ~wrong[a_row], ~wrong[b_row]
        a, a_row, b, b_row = a[keep_a], a_row[keep_a], b[keep_b], b_row[keep_b]
    a_end, b_end = np.cumsum(first.widths[a]), np.cumsum(second.widths[b])
    a_start, b_start = a_end - first.widths[a], b_end - second.widths[b]
    a_group, b_group, groups = coalesced(a_start, a_end, b_start, b_end)
    group_row = np.zeros(groups, np.int64)
    group_row[a_group] = a_row
    pair_a, pair_b = overlaps(a_start, a_end, b_start, b_end)
    return Aligned(n, ~wrong, a, b, a_row, b_row, a_group, b_group, group_row, pair_a, pair_b, a_end[pair_a] == b_end[pair_b])


def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of numbers below 100,000, and how many."""
    n = np.arange(100_000)
    size = 1 + sum((n >= 10**k).astype(np.int64) for k in range(1, 5))
    table = np.zeros((100_000, 5), np.uint8)
    for k in range(5):  # the k-th digit from the left
        table[:, k] = 48 + n // 10 ** np.maximum(size - 1 - k, 0) % 10
    return table, size


_table: list[np.ndarray] = []


def group_texts(x: Aligned) -> tuple[bytes, np.ndarray]:
    """Groups as text, a1,a2|b1;a3|b2,b3; of all rows, and where each row begins. Each row ends in an additional semicolon."""
    if not _table:
        _table.extend(_digits())
    table, size = _table
    na, nb = len(x.a), len(x.b)
    groups = len(x.group_row)
    of_a, of_b = np.bincount(x.a_group, minlength=groups), np.bincount(x.b_group, minlength=groups)
    # the place of a token: those of its own side before it, and those of the other side in the groups before (or up to) its own
    ids, marks = np.empty(na + nb, np.int64), np.full(na + nb, ord(","), np.uint8)
    at_a = np.arange(na) + np.repeat(np.cumsum(of_b) - of_b, of_a)
    at_b = np.arange(nb) + np.repeat(np.cumsum(of_a), of_b)
    ids[at_a], ids[at_b] = x.a, x.b
    last = np.cumsum(of_a + of_b) - 1
    marks[last], marks[last - of_b] = ord(";"), ord("|")
    wide = size[ids] if not len(ids) or ids.max() < 100_000 else None
    if wide is None:
        parts = [f"{k}{chr(m)}".encode() for k, m in zip(ids.tolist(), marks.tolist(), strict=True)]
        out, total = b"".join(parts), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    else:
        total = np.cumsum(wide + 1)
        begin = total - wide - 1
        buffer = np.empty(int(total[-1]) if len(total) else 0, np.uint8)
        for k in range(5):
            some = np.flatnonzero(wide > k)
            buffer[begin[some] + k] = table[ids[some], k]
        buffer[total - 1] = marks
        out = buffer.tobytes()
    tokens = np.bincount(x.a_row, minlength=x.rows) + np.bincount(x.b_row, minlength=x.rows)
    return out, np.append(0, total)[np.append(0, np.cumsum(tokens))]


def _segments(data: np.ndarray, limit: int) -> np.ndarray:
    """Offsets that cut one long text, where it can be, into stretches of some `limit` bytes: before a space between visible characters, where tokens of either kind end."""
    here = np.flatnonzero((data[1:-1] == 0x20) & (data[:-2] != 0x20) & _visible[data[2:]]) + 1
    cuts, at = [0], 0
    while len(data) - at > limit:
        k = int(np.searchsorted(here, at + limit, side="right")) - 1
        k += 0 if k >= 0 and here[k] > at else 1
        if k >= len(here):
            break
        at = int(here[k])
        cuts.append(at)
    return np.array([*cuts, len(data)])


def _spaced(column: pa.Array) -> pa.Array:
    """The texts with a space before each; null and empty texts stay empty."""
    text = pc.fill_null(column, "")
    return pc.if_else(pc.equal(pc.binary_length(text), 0), "", pc.binary_join_element_wise(" ", text, ""))


def _valid(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


def _pieces(column: pa.Array, first: ByteEncoder, second: PieceEncoder, limit: int) -> Iterator[tuple[int, int, np.ndarray, Aligned]]:
    """Runs of rows lo..hi with the row, counted from lo, of each stretch that was aligned, and their alignment."""
    for lo, hi, data, offsets in T.pieces(_spaced(column), limit):
        owners = np.arange(hi - lo)
        if hi - lo == 1 and len(data) > limit and second.cuttable:
            offsets = _segments(data, limit)
            owners = np.zeros(len(offsets) - 1, np.int64)
        if not _valid(data):  # bytes that are no text come back from no token
            bad = np.array([not _valid(data[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)])
            data = np.concatenate([np.frombuffer(MARK.encode(), np.uint8) if w else data[i:j] for w, i, j in zip(bad, offsets[:-1], offsets[1:], strict=True)])
            offsets = np.append(0, np.cumsum(np.where(bad, 3, np.diff(offsets))))
        # a long text goes stretch by stretch
        steps = [(k, k + 1) for k in range(len(owners))] if len(owners) > 1 and owners[-1] == 0 else [(0, len(owners))]
        for i, j in steps:
            yield lo, hi, owners[i:j], align(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], first, second)


LISTS = "doc_id long, a_ids array<int>, b_ids array<int>, a_counts array<int>, b_counts array<int>, pair_a array<int>, pair_b array<int>, together array<boolean>"


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None, limit: int = T.PIECE) -> DataFrame:
    """doc_id, ids of either tokenizer, the tokens of either in each group, and the overlapping pairs as places of tokens, with whether they end together.

    a: a byte-level BPE file; b: a SentencePiece model that adds a space. Null and empty texts, and texts whose tokens do not
    give back a space and the text (such as those that hold U+2581), have empty lists. Ids are kept as they are: null
    and repeated ids have a row each. Texts above `limit` bytes are aligned in stretches; columns other than doc_id and text are not read.
    """
    a, b = a or default_tokenizer(), b or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _encoders(a, b)
        for batch in batches:
            held: dict[int, list[tuple]] = {}
            for lo, _, owners, x in _pieces(batch.column(1), first, second, limit):
                of_a, of_b = np.bincount(x.a_row, minlength=x.rows), np.bincount(x.b_row, minlength=x.rows)
                base_a, base_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
                for k in range(x.rows):
                    own = x.a[base_a[k] : base_a[k] + of_a[k]], x.b[base_b[k] : base_b[k] + of_b[k]]
                    g, h = x.a_group[base_a[k] : base_a[k] + of_a[k]], x.b_group[base_b[k] : base_b[k] + of_b[k]]
                    counts = (np.unique(g, return_counts=True)[1], np.unique(h, return_counts=True)[1])
                    i, j = np.searchsorted(x.pair_a, (base_a[k], base_a[k] + of_a[k]))
                    held.setdefault(lo + int(owners[k]), []).append((bool(x.exact[k]), *own, *counts, x.pair_a[i:j] - base_a[k], x.pair_b[i:j] - base_b[k], x.together[i:j]))
            lists: list[list] = [[] for _ in range(7)]
            for k in range(batch.num_rows):
                parts = held.get(k, [])
                parts = parts if all(p[0] for p in parts) else []
                shift_a = shift_b = 0
                whole: list[list[np.ndarray]] = [[] for _ in range(7)]
                for _, ia, ib, ca, cb, pa_, pb, t in parts:
                    for q, v in zip(whole, (ia, ib, ca, cb, pa_ + shift_a, pb + shift_b, t), strict=True):
                        q.append(v)
                    shift_a, shift_b = shift_a + len(ia), shift_b + len(ib)
                for q, v in zip(lists, whole, strict=True):
                    q.append(np.concatenate(v) if v else np.zeros(0, np.int32))
            kinds = [pa.list_(pa.int32())] * 6 + [pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([v.astype(bool if c == 6 else np.int32) for v in q], kind) for c, (q, kind) in enumerate(zip(lists, kinds, strict=True))]], schema=pa.schema([("doc_id", pa.int64())] + list(zip("a_ids b_ids a_counts b_counts pair_a pair_b together".split(), kinds, strict=True))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LISTS)


LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"


def document_links(docs: DataFrame, a: str | None = None, b: str | None = None, limit: int = T.PIECE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the pairs of ids whose tokens end together, with how often: codes
    (id of a times 2**20, plus id of b) and times. The same alignment as `alignments`, summed up where it is made; a code may repeat."""
    a, b = a or default_tokenizer(), b or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _encoders(a, b)
        for batch in batches:
            n = batch.num_rows
            sums, exact, state = np.zeros((4, n), np.int64), np.ones(n, bool), [None] * n
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, _, owners, x in _pieces(batch.column(1), first, second, limit):
                at = lo + owners
                tied_a, tied_b = x.pair_a[x.together], x.pair_b[x.together]
                link_row = x.a_row[tied_a]
                for k, rows in enumerate((x.a_row, x.b_row, x.group_row, link_row)):
                    np.add.at(sums[k], at, np.bincount(rows, minlength=x.rows))
                exact[at[~x.exact]] = False
                # link_row is below the rows of a piece, so a row and a code share 64 bits
                keys, times = np.unique((link_row << 40) | (x.a[tied_a].astype(np.int64) << 20) | x.b[tied_b], return_counts=True)
                found.append((at[keys >> 40], keys & ((1 << 40) - 1), times))
                data, begin = group_texts(x)
                view = memoryview(data)
                for k, (i, j) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
                    if j > i:
                        own = at[k]
                        if state[own] is None:
                            state[own] = hashlib.sha256(view[i : j - 1])
                        else:  # a further stretch of a long text
                            state[own].update(b";")
                            state[own].update(view[i : j - 1])
            sums[:, ~exact] = 0
            shas = [s.hexdigest() if s is not None and e else "" for s, e in zip(state, exact.tolist(), strict=True)]
            rows, codes, times = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            keep = exact[rows]
            rows, codes, times = rows[keep], codes[keep], times[keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(s) for s in sums], pa.array(shas, pa.string()), T.lists(codes, rows, n, pa.int64()), T.lists(times.astype(np.int32), rows, n, pa.int32())],
                names="doc_id n_a n_b n_groups n_links groups_sha256 codes times".split(),
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LINKS)


def pair_counts(links: DataFrame) -> DataFrame:
    """code, links, best: how many links of the corpus hold a pair of ids, and whether that is the highest count of its id of b.

    Tokens that end together at one byte are each a suffix of the other's bytes or the other way round, so there are no more
    pairs than the tokens of both vocabularies have suffixes: some 0.6 million for 50,000 and 32,000 tokens, whatever the corpus.
    """
    each = links.select(F.explode(F.arrays_zip("codes", "times")).alias("p")).groupBy(F.col("p.codes").alias("code")).agg(F.sum("p.times").cast("long").alias("links"))
    return each.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy(F.col("code").bitwiseAND(F.lit((1 << 20) - 1)))))


def alignment_digest(docs: DataFrame, a: str | None = None, b: str | None = None, limit: int = T.PIECE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Documents are encoded and aligned once; what they hold of the pairs is kept as lists until the counts of the corpus are known. The table
    of counts is bounded by the vocabularies (see pair_counts) and is broadcast.
    """
    links = written(document_links(docs, a, b, limit), "alignment")
    pairs = written(pair_counts(links), "pair-counts").toArrow().sort_by("code")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pairs.column(c).to_numpy() for c in ("code", "links", "best")))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = shared.value
        for batch in batches:
            codes, times = batch.column(6), batch.column(7).flatten().to_numpy().astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(codes).to_numpy(zero_copy_only=False))
            at = np.searchsorted(code, codes.flatten().to_numpy())
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], rows, times * best[at] if len(at) else times)
            np.add.at(sums[1], rows, times * count[at] if len(at) else times)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums[0]), pa.array(sums[1]), batch.column(5)], names="doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split())

    return links.mapInArrow(looked_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
