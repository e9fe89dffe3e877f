"""Spark's xxhash64 of whole numbers, outside Spark: for a few keys whose buckets are to be read."""

from __future__ import annotations

import struct

import xxhash


def hash_of(*values: int) -> int:
    """F.xxhash64 of long columns with these values."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h
