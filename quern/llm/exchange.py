"""Packed exchange of hashes between groups of documents and hash buckets.

A corpus-wide question about hashes ("which of my windows occur elsewhere?", "how often does
my word occur in all?") is asked by each *group* of documents (a few MB of text, dealt by a
hash of the id) and answered by each *bucket* of the hash space.  A group sends every distinct
hash once, sorted and delta-coded, so the shuffle carries about three bytes for a hash rather
than a row; copies within a group are combined before anything is sent, so one hot text costs
a group no more than any other.  Both sides are bounded: a group by ``group_bytes`` of text, a
bucket by ``bucket_hashes`` (their numbers grow with the input, never their sizes).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 4 << 20
BUCKET_HASHES = 4_000_000


@dataclass(frozen=True)
class Layout:
    groups: int
    buckets: int
    rows: int


def plan(docs: DataFrame, text: str, group_bytes: int = GROUP_BYTES, bucket_hashes: int = BUCKET_HASHES, bytes_a_hash: float = 6.5) -> Layout:
    """Numbers of groups and buckets for these texts, from one narrow aggregate."""
    row = docs.agg(F.sum(F.octet_length(text).cast("long")), F.count(F.lit(1))).first()
    size, rows = row[0] or 0, row[1]
    return Layout(max(1, -(-size // group_bytes), -(-rows // 200_000)), max(1, int(size / bytes_a_hash / bucket_hashes) + 1), rows)


def group_of(key: Column, layout: Layout) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(layout.groups)).cast("int")


def bucket_bounds(buckets: int, bits: int) -> np.ndarray:
    """Least hash of each bucket, of hashes with that many bits, and one past the last."""
    return np.array([-(-(i << bits) // buckets) for i in range(buckets + 1)], np.uint64) if bits < 64 else np.array([min(-(-(i << 64) // buckets), (1 << 64) - 1) for i in range(buckets + 1)], np.uint64)


def planes(x: np.ndarray) -> bytes:
    """The low bytes of all numbers, then the next ones, and so on: high bytes are mostly zeros, which the shuffle's compression removes."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return bytes([width]) + np.ascontiguousarray(raw[:, :width].T).tobytes()


def unplanes(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    """The numbers and how many bytes they took."""
    width = data[0]
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8, n * width, 1).reshape(width, n).T
    return raw.reshape(-1).view("<u8"), 1 + n * width


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted uint64 numbers as deltas."""
    d = x.copy()
    d[1:] -= x[:-1]
    return planes(d)


def unpack_sorted(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    d, used = unplanes(data, n)
    return np.cumsum(d, dtype=np.uint64), used


def pack_bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unpack_bits(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    used = (n + 7) // 8
    return np.unpackbits(np.frombuffer(data, np.uint8, used), count=n).astype(bool), used
