"""Vectorised word splitting and hashing of Arrow string columns.

Words are maximal runs of bytes other than space and ``\\t \\n \\x0b \\x0c \\r``.  All
functions work on a whole Arrow column at once: Python never loops over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_SHIFT = U(33)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


@dataclass
class Tokens:
    """Words of a column of texts. ``doc`` is the row of each word; ``first`` has, for each row
    and one past the last, the index of its first word."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def tokenize(col: pa.Array | pa.ChunkedArray, lower: bool = False) -> Tokens:
    buf, off = column_bytes(col)
    if lower:
        buf = LOWER[buf]
    n = len(off) - 1
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return Tokens(buf, z, z, z, np.zeros(n + 1, np.int64))
    edge = np.ones(len(buf) + 1, bool)  # edge[i]: a word may not run over from byte i-1 to byte i
    space = IS_SPACE[buf]
    edge[1:-1] = space[1:] | space[:-1]
    edge[off] = True
    word = ~space
    start = np.flatnonzero(word & edge[:-1])
    end = np.flatnonzero(word & edge[1:]) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(n), np.diff(first))
    return Tokens(buf, start, end, doc, first)


def hash_slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte slices, eight bytes of all slices at a time."""
    length = (end - start).astype(np.int64)
    h = mix(length.astype(U) + U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF))
    if len(start) == 0:
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    at, left, rows = start, length, None
    while len(at):
        mask = np.where(left >= 8, U(0xFFFFFFFFFFFFFFFF), (U(1) << (U(8) * np.clip(left, 0, 7).astype(U))) - U(1))
        chunk = eight[at] & mask
        if rows is None:
            h = mix(h ^ chunk)
            rows = np.flatnonzero(left > 8)
            at, left = at[rows] + 8, left[rows] - 8
        else:
            h[rows] = mix(h[rows] * _M1 ^ chunk)
            more = np.flatnonzero(left > 8)
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return h


def word_hashes(t: Tokens, seed: int = 0) -> np.ndarray:
    return hash_slices(t.buf, t.start, t.end, seed)


def join_hash(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the pair (a, b); not symmetric."""
    return mix(a * _M2 + b + U((0x632BE59BD9B4E019 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF))


def rolling(wh: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of every run of k consecutive elements, by doubling; ``max(0, len - k + 1)`` long."""
    if len(wh) < k:
        return np.zeros(0, U)
    out, have, power, span = None, 0, wh, 1
    while True:
        if k & span:
            n = len(wh) - have - span + 1
            out = power if out is None else join_hash(out[:n], power[have : have + n], seed + 1)
            have += span
        if span * 2 > k:
            return out
        power = join_hash(power[:-span], power[span:], seed)
        span *= 2


def take_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, sep: int | None = 32) -> tuple[np.ndarray, np.ndarray]:
    """The slices one after another, each followed by ``sep``; (bytes, where each begins, one past the last)."""
    length = end - start + (sep is not None)
    begin = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=begin[1:])
    src = np.repeat(start - begin[:-1], length)
    src += np.arange(begin[-1])
    if sep is not None and len(start):
        last = begin[1:] - 1
        src[last] = 0
        out = buf[src]
        out[last] = sep
        return out, begin
    return buf[src] if len(src) else np.zeros(0, np.uint8), begin


def join_kept(t: Tokens, keep: np.ndarray) -> pa.Array:
    """One text for each row: its kept words joined by one space."""
    rows = len(t.first) - 1
    at = np.flatnonzero(keep)
    out, begin = take_bytes(t.buf, t.start[at], t.end[at])
    n = np.bincount(t.doc[at], minlength=rows) if len(at) else np.zeros(rows, np.int64)
    ends = begin[np.cumsum(n)] if len(at) else np.zeros(rows, np.int64)
    solid = np.ones(len(out), bool)
    if len(out):
        solid[ends[n > 0] - 1] = False  # no separator after a row's last word
    out = out[solid]
    off = np.zeros(rows + 1, np.int64)
    off[1:] = ends - np.cumsum(n > 0)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(off), pa.py_buffer(out)) if rows else pa.array([], pa.large_string())
