"""Sorted keys and numbers beside them as bytes, by parts of the key space."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, none below 0: the bytes in use, all first ones, then all second ones, compressed."""
    out = []
    for column in columns:
        column = np.ascontiguousarray(column).astype(np.uint64, copy=False)
        width = max(1, (int(column.max(initial=0)).bit_length() + 7) // 8)
        body = pa.compress(column.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), codec="zstd", asbytes=True)
        out += [struct.pack("<QQB", len(column), len(body), width), body]
    return b"".join(out)


def unpacked(body: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(body):
        n, size, width = struct.unpack_from("<QQB", body, at)
        at += 17
        planes = pa.decompress(body[at: at + size], decompressed_size=n * width, codec="zstd") if n else b""
        column = np.zeros((n, 8), np.uint8)
        column[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
        out.append(column.view(np.uint64).ravel())
        at += size
    return out


def gaps(keys: np.ndarray, start: int = 0) -> np.ndarray:
    """Sorted keys as the differences that follow one another from ``start``."""
    return np.diff(keys, prepend=np.uint64(start))


def part_starts(parts: int) -> np.ndarray:
    """The least key of each part of the key space."""
    return np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], np.uint64)


def ordered(keys: np.ndarray) -> np.ndarray:
    """The order of keys, equal ones by place: sorted as numbers that end in the place, unless what that cuts off counts."""
    if not len(keys):
        return np.empty(0, np.int64)
    low, bits = keys.min(), np.uint64(len(keys).bit_length())
    both = keys - low << np.uint64(64 - int(keys.max() - low).bit_length() if keys.max() > low else 0)
    both = both >> bits << bits | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    both &= (np.uint64(1) << bits) - np.uint64(1)
    order = both.view(np.int64)
    found = keys[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(keys, kind="stable")
