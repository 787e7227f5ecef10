"""Vectorised word kernels shared by the corpus operators.

They run inside Spark tasks on Arrow batches: a string column's value buffer is viewed as one byte array, so that
finding and hashing the words of a whole batch takes a few numpy passes and no Python loop over words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that end a word: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Text bytes handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers (mod 2**64) of an odd multiplier or of its inverse."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        b = _BASE[which]
        base = pow(b, -1, 1 << 64) if inverse else b
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 2 * CHUNK_BYTES:
            _powers[which, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer of 64-bit values (a bijection)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def fold(values: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """Hash of each run of `width` consecutive values; entry i covers values[i:i+width]."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(which, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(which, n - width + 1, True))


@dataclass
class Words:
    """Words of consecutive texts: `starts`/`ends` are byte places in `data`; text i owns words first[i]:first[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        table = _BYTE
        if lower:
            table = _BYTE.copy()
            table[65:91] = _BYTE[97:123]
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[self.data] * powers(0, n), out=sums[1:])
        out = (sums[self.ends] - sums[self.starts]) * powers(0, n + 1, True)[self.starts]
        return mix(out + (self.ends - self.starts).astype(np.uint64))

    def owner(self) -> np.ndarray:
        """The text index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray = SPACE) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]: longest runs of bytes that `stop` doesn't mark."""
    inside = ~stop[data]
    cut = offsets[:-1][np.diff(offsets) > 0]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cut[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Splits a batch into row slices of about CHUNK_BYTES of text: (rows, bytes, offsets)."""
    data, offsets = string_parts(batch.column(text))
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield slice(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    release()


def release() -> None:
    """Gives memory that is free but still held back to the system: workers live on between batches and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches in which the rows of a key stand together: tables of whole groups, and where each group starts (with
    the end). Holds one batch and the group that it ends in, so groups must be bounded by the caller."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        if held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[-1].as_py() for k in keys):
            held.append(batch)
            continue
        t = pa.Table.from_batches([*held, batch]).combine_chunks()
        at = starts(t)
        cut = int(at[-1])
        if cut:
            yield t.slice(0, cut), at
        held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        at = starts(t)
        yield t, np.append(at, len(t))
    held = []
    release()


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that connect what a symmetric boolean matrix connects."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]
