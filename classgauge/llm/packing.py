"""Whole numbers in few bytes, and keys that blocks deal out to buckets and get values back for."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

DEALT_DDL = "bucket int, block string, keys binary, first binary, second binary"
DEALT = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("keys", pa.binary()), ("first", pa.binary()), ("second", pa.binary())])
MERGED_DDL = "bucket int, keys binary, first binary, second binary, blocks array<string>, places array<binary>"
MERGED = pa.schema([
    ("bucket", pa.int32()), ("keys", pa.binary()), ("first", pa.binary()), ("second", pa.binary()), ("blocks", pa.list_(pa.string())), ("places", pa.list_(pa.binary())),
])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as their differences, compressed; ascending ones take few bytes."""
    return zlib.compress(np.diff(values.astype(np.int64), prepend=np.int64(0)).tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.int64))


def packed_planes(values: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, their lowest bytes first, then the next; small ones in any order take few bytes."""
    return zlib.compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_planes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<i4").ravel().astype(np.int64)


def packed_levels(values: np.ndarray) -> bytes:
    """Numbers of which few are distinct, exactly: those, and which of them each is."""
    levels, at = np.unique(values, return_inverse=True)
    return np.int64(len(levels)).tobytes() + levels.astype(np.float64).tobytes() + packed_planes(at)


def unpacked_levels(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.float64, n, 8)[unpacked_planes(blob[8 + 8 * n :])]


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, each without the leading bytes that it shares with the one before."""
    n = len(keys)
    rows = keys.astype(">i8").view(np.uint8).reshape(n, 8)
    same = np.zeros((n, 8), bool)
    same[1:] = np.logical_and.accumulate(rows[1:] == rows[:-1], axis=1)
    return np.int64(n).tobytes() + zlib.compress(same.sum(1).astype(np.uint8).tobytes() + rows[~same].tobytes(), 1)


def unpacked_keys(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    raw = np.frombuffer(zlib.decompress(blob[8:]), np.uint8)
    shared = raw[:n]
    rows = np.zeros((n, 8), np.uint8)
    rows[np.arange(8) >= shared[:, None]] = raw[n:]
    for j in range(8):  # a shared byte is that of the last key that has its own
        rows[:, j] = rows[np.maximum.accumulate(np.where(shared <= j, np.arange(n), 0)), j]
    return rows.view(">i8").ravel().astype(np.int64)


def dealt_rows(block: str, bucket: np.ndarray, keys: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[tuple]:
    """A block's keys with two counts each, as a row for each bucket; ``bucket`` ascends, and the keys in it."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    cuts = zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)
    return [(int(bucket[a]), block, packed_keys(keys[a:b]), packed(first[a:b]), packed(second[a:b])) for a, b in cuts]


def merged(table: pa.Table) -> pa.Table:
    """A bucket's keys from all blocks, each once, with summed counts; and where each block's keys are among them."""
    rows = table.to_pydict()
    keys = [unpacked_keys(k) for k in rows["keys"]]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    new = np.diff(every[order], prepend=every[order][:1] - 1) != 0
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    distinct = every[order][new]
    sums = []
    for name in ("first", "second"):
        n = np.zeros(len(distinct), np.int64)
        np.add.at(n, place, np.concatenate([unpacked(c) for c in rows[name]]))
        sums.append(packed(n))
    places = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    row = (rows["bucket"][0], packed_keys(distinct), *sums, rows["block"], [packed(p) for p in places])
    return pa.table([pa.array([v], t) for v, t in zip(row, MERGED.types, strict=True)], schema=MERGED)
