"""Encoding of whole texts with a byte-level BPE tokenizer, each distinct chunk of a worker once.

A byte-level BPE with the usual split pattern never makes a token across a space that precedes a visible
character, nor between an ASCII letter or digit and ASCII punctuation other than an apostrophe. Texts are cut
there, chunks are told apart by 64-bit hashes, and only chunks that the worker has not met go through the
tokenizers library; ids of texts are then gathered with numpy.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from panelrisk.llm import text as T

SLOTS, ENTRIES = 1 << 21, 3_000_000

_digits_letters = T.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_punctuation = T.byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: First bytes of characters that are no white space: visible ASCII, and lead bytes of no Unicode space.
_visible = T.byte_class((0x21, 0x7E), (0xC3, 0xDF), (0xE4, 0xF4))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable_bytes() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else 256 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, as encode(text, add_special_tokens=False) of the tokenizers library gives them.

    plain: the strings of special tokens inside a text are plain text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = _printable_bytes()
        #: Tokens that the library takes out of a text before it splits it; they are never cut.
        self.whole = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = plain
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot_entry = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.offsets, self.n, self.ids, self.used = np.zeros(1 << 16, np.int64), 0, np.zeros(1 << 18, np.int32), 0

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        out: list = [None] * len(chunks)
        rest = []
        for k, c in enumerate(chunks):
            body = c[1:] if c[:1] == " " else c
            if body.isalpha() and max(body) < "ɐ":  # one piece of the split pattern
                out[k] = [x.id for x in self.tokenizer.model.tokenize(c.encode().decode("latin-1").translate(self.table))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def _add(self, keys: np.ndarray, chunks: list[str]) -> np.ndarray:
        ids = self._encode(chunks)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.int32, int(sizes.sum()))
        while self.n + len(ids) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.offsets[self.n + 1 : self.n + len(ids) + 1] = self.used + np.cumsum(sizes)
        entries = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        self.n, self.used = self.n + len(ids), self.used + len(flat)
        slots = (keys % np.uint64(SLOTS)).astype(np.int64)
        self.keys[slots], self.slot_entry[slots] = keys, entries
        # of two keys with one slot, the entry must be that of the key that is kept there
        self.slot_entry[slots] = np.where(self.keys[slots] == keys, entries, self.slot_entry[slots])
        return entries

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a chunk begins at each byte (or ends at the last)."""
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        cut[1:-1] |= (_digits_letters[data[:-1]] & _punctuation[data[1:]]) | np.append((data[1:-1] == 0x20) & _visible[data[2:]], False)[: n - 1]
        last = offsets[1:][offsets[1:] > 0] - 1
        cut[last[data[last] == 0x20]] = False  # what follows the last space of a row is another row
        raw = data.tobytes() if self.whole else b""
        for token in self.whole:
            k = raw.find(token)
            while k >= 0:
                cut[k + 1 : k + len(token)] = False
                k = raw.find(token, k + 1)
        return cut

    def _entries(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each chunk and the row that it is in."""
        cut = self._cuts(data, offsets)
        cut[offsets] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        rows = np.searchsorted(offsets, starts, side="right") - 1
        keys = T.stretch_hashes(data, starts, ends)
        slots = (keys % np.uint64(SLOTS)).astype(np.int64)
        entries = self.slot_entry[slots]
        unknown = np.flatnonzero(self.keys[slots] != keys)
        if len(unknown):
            raw = data.tobytes()
            own, first, back = np.unique(keys[unknown], return_index=True, return_inverse=True)
            where = unknown[first]
            entries[unknown] = self._add(own, [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])[back]
        return entries, rows

    def rows(self, column: pa.Array, with_ids: bool = True):
        """For runs of rows: lo, hi, the number of ids of each, and the ids of all one after the other (or None)."""
        for lo, hi, data, offsets in T.pieces(column):
            if self.n > ENTRIES:
                self.forget()
            if not len(data):
                yield lo, hi, np.zeros(hi - lo, np.int64), np.zeros(0, np.int32)
                continue
            entries, rows = self._entries(data, offsets)
            begin = self.offsets[entries]
            sizes = self.offsets[entries + 1] - begin
            counts = np.bincount(rows, weights=sizes, minlength=hi - lo).astype(np.int64)
            ids = None
            if with_ids:
                total = np.cumsum(sizes)
                ids = self.ids[np.repeat(begin - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)]
            yield lo, hi, counts, ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
