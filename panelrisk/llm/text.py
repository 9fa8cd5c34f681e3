"""Vectorised words, rolling hashes and content-chosen positions over Arrow batches of texts.

Texts of a batch lie one after the other in one byte buffer; everything here works on that buffer with
numpy, so that no Python object is made for a word. Hashes are 64-bit polynomials over random byte
values, finished with a bijective mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MULT = 0x9E3779B97F4A7C15
INVERSE = pow(MULT, -1, 2**64)
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
PIECE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finish of 64-bit values (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUES = mix((np.arange(1, 257, dtype=U)) * U(MULT))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), PIECE + 1)
        for k, base in enumerate((MULT, INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table that is True for the bytes in the ranges, ends included."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Word bytes: all but space and \t \n \v \f \r.
SPACED = ~byte_class((0x09, 0x0D), (0x20, 0x20))
#: Word bytes: digits, a-z, and all that is not ASCII; after lower-casing.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows lo..hi of at most `limit` bytes (or one row), with their bytes and offsets from 0."""
    data, offsets = buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row that each is in; words never cross rows."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = word[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values * MULT**i, from which `rolled` takes hashes of stretches."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def rolled(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches starts..ends of what `prefix` has summed."""
    return (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of byte stretches, their lengths included."""
    h = rolled(prefix(BYTE_VALUES[data]), starts, ends)
    return mix(h ^ ((ends - starts).astype(U) * U(0xD6E8FEB86659FD93) + U(salt)))


def window_hashes(values: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k consecutive values, by first index; len(values) - k + 1 of them, at least 0."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = prefix(mix(values + U(salt)) if salt else values)
    return mix((sums[k:] - sums[:n]) * powers(n)[1] + U(k))


def slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w consecutive values."""
    done = 1
    while done < w:
        step = min(done, w - done)
        a = op(a[:-step], a[step:])
        done += step
    return a


def minimizers(a: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Positions that hold the least value of some valid run of w positions; valid: by first position.

    Which positions these are depends on the content of the run alone, so equal runs choose equal positions.
    """
    if len(a) < w or not valid.any():
        return np.zeros(0, np.int64)
    least = np.where(valid[: len(a) - w + 1], slide(a, w, np.minimum), U(0))
    padded = np.zeros(len(a) + w - 1, U)
    padded[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero((slide(padded, w, np.maximum) == a) & (a > 0))


def lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Arrow lists of the values by row (rows ascending), for n rows."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
