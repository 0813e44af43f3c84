"""32-bit FNV-1a over many byte strings at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Offset and prime of 32-bit FNV-1a.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: With fewer strings left than this, each is folded by itself.
FEW = 8


def fnv_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The checksum of each data[offsets[i]:offsets[i + 1]]; one position of all strings in a step."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, shrinking = offsets[:-1][order], -size[order]
    h = np.full(len(size), FNV_OFFSET, np.uint32)
    k, prime = 0, np.uint32(FNV_PRIME)
    while (live := int(np.searchsorted(shrinking, -k))) >= FEW:  # those with more than k bytes stand first
        h[:live] = (h[:live] ^ data[start[:live] + k]) * prime
        k += 1
    for i in range(live):
        x = int(h[i])
        for b in data[start[i] + k : start[i] - shrinking[i]].tolist():
            x = (x ^ b) * FNV_PRIME & 0xFFFFFFFF
        h[i] = x
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv_of_strings(parts: list[bytes]) -> np.ndarray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return fnv_of(np.frombuffer(b"".join(parts), np.uint8), offsets)


def fnv1a(data: Column) -> Column:
    """32-bit FNV-1a of a binary column, as long; null for null."""

    @arrow_udf("long")
    def fold(column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_binary())
        plain = column.fill_null(b"") if column.null_count else column
        offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
        raw = plain.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        sums = pa.array(fnv_of(raw, offsets).astype(np.int64))
        return pa.compute.if_else(column.is_valid(), sums, None) if column.null_count else sums

    return fold(data)
