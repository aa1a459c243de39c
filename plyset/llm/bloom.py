"""Bloom filters: log-frequency regions, and a filter of keys of bounded size before a join.

An item seen c times is inserted at the levels 1 .. 1 + floor(log2 c); reading probes level after
level until one is missing. Plain membership is level 1. Filters are built in regions, one for each
bucket of items, so that tasks fill them apart. Regions grow with their items; only those of a filter
that is broadcast take no more bits than their share of its bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyset.llm.text import mix

BITS, PROBES = 10, 6
MAX_FILTER = 64 << 20
#: A key filter with fewer bits for each key would let most others pass: then the join is a plain one.
LEAST_BITS = 4


def bits_at(items: np.ndarray, level: np.ndarray, size: int) -> np.ndarray:
    """Bit positions (items x PROBES) in a region of ``size`` bits."""
    a = mix(items + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = mix(a ^ np.uint64(0x94D049BB133111EB)) | np.uint64(1)
    steps = a[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * b[:, None]
    return ((steps >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def fill(items: np.ndarray, counts: np.ndarray, most_bits: int) -> bytes:
    """A region that holds the items at their levels, of ``most_bits`` at most."""
    levels = np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c)
    size = int(min(max(1024, BITS * int(levels.sum())), most_bits, (1 << 32) - 64))
    size = -(-size // 8) * 8
    region = np.zeros(size // 8, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = items[levels >= level]
        for k in range(0, len(own), 1 << 17):
            at = bits_at(own[k : k + (1 << 17)], np.uint64(level) * np.ones(len(own[k : k + (1 << 17)]), np.uint64), size).ravel()
            np.bitwise_or.at(region, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
    return region.tobytes()


def levels_of(items: np.ndarray, bucket: np.ndarray, filter_: tuple[np.ndarray, np.ndarray], highest: int = 64) -> np.ndarray:
    """The level read back for each item: probes go on until one misses, to the ``highest`` level inserted at most."""
    data, offsets = filter_
    level = np.zeros(len(items), np.int64)
    for k in range(0, len(items), 1 << 17):
        alive = np.arange(k, min(k + (1 << 17), len(items)))
        n = 0
        while len(alive) and n < highest:
            n += 1
            own = bucket[alive]
            size = (offsets[own + 1] - offsets[own]) * 8
            a = mix(items[alive] + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            b = mix(a ^ np.uint64(0x94D049BB133111EB)) | np.uint64(1)
            here = np.ones(len(alive), bool)
            for j in range(PROBES):
                at = (((a + np.uint64(j) * b) >> np.uint64(32)) * size.astype(np.uint64)) >> np.uint64(32)
                here &= (data[offsets[own] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if j == 1 and not here.all():  # most absent items are gone after two probes
                    keep = here
                    alive, own, size, a, b, here = alive[keep], own[keep], size[keep], a[keep], b[keep], here[keep]
            alive = alive[here]
            level[alive] = n
    return level


class KeyFilter:
    """True for all keys that it was built from and few others; ``test`` works on arrays, ``column`` on a Spark column of longs."""

    def __init__(self, parts, buckets: int):
        self.parts, self.buckets = parts, buckets

    def test(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        bucket = keys % self.buckets
        for b in np.unique(bucket):
            own = np.flatnonzero(bucket == b)
            bits = self.parts.value[b]
            at = bits_at(keys[own].view(np.uint64), np.ones(len(own), np.uint64), len(bits) * 8)
            out[own] = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
        return out

    def column(self, keys):
        @F.pandas_udf("boolean")
        def held(column: pd.Series) -> pd.Series:
            return pd.Series(self.test(column.to_numpy(np.int64)))

        return held(keys)


class Same:
    """Says the same of every key; nothing is built or sent."""

    def __init__(self, says: bool):
        self.says = says

    def test(self, keys: np.ndarray) -> np.ndarray:
        return np.full(len(keys), self.says)

    def column(self, keys):
        return F.lit(self.says)


def key_filter(keys: DataFrame, max_filter: int | None = None, beyond: bool = True) -> KeyFilter | Same:
    """A filter of the frame's ``key`` column (longs) of ``max_filter`` (``MAX_FILTER``) bytes at most, broadcast to the workers.

    With more keys than that can tell apart (``LEAST_BITS`` each) it is none: every key gets the answer
    ``beyond``. True means that all rows go into the join that the filter stands before, which is exact at any size.
    """
    n = keys.count()
    max_filter = MAX_FILTER if max_filter is None else max_filter
    if n * LEAST_BITS > max_filter * 8:
        return Same(beyond)
    buckets = max(1, n >> 17)
    share = max_filter * 8 // buckets

    def region(key, t):
        items = t.column("key").to_numpy().view(np.uint64)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([fill(items, np.ones(len(items), np.int64), share)], pa.binary())})

    parts: list[bytes] = [bytes(128)] * buckets
    for r in keys.select(F.pmod("key", F.lit(buckets)).cast("long").alias("bucket"), "key").groupBy("bucket").applyInArrow(region, "bucket long, bits binary").toLocalIterator():
        parts[r.bucket] = bytes(r.bits)
    return KeyFilter(keys.sparkSession.sparkContext.broadcast([np.frombuffer(b, np.uint8) for b in parts]), buckets)
