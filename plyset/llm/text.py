"""Vectorised tokens over Arrow string arrays: boundaries and 64-bit hashes of words.

Words are maximal runs of bytes outside 0x09-0x0D and 0x20, with A-Z folded to a-z. All of it
works on UTF-8 bytes, where those separators never occur inside a character.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_MULT = 0x5851F42D4C957F2D
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_FOLDED = _BYTE[FOLD]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0..n-1 modulo 2**64, and their inverses."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SEGMENT + 1)
        inverse = pow(_MULT, -1, 1 << 64)
        both = []
        for base in (_MULT, inverse):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers = (both[0], both[1])
    return _powers


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and where each starts (nulls count as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def range_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) of 64-bit codes, independent of where they lie."""
    up, down = powers(len(codes) + 1)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, in order; no word spans two strings."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    codes = _BYTE_FOLDED if fold else _BYTE
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # in segments, so that a very long text needs little memory
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        hashes[i:j] = range_hash(codes[data[lo:hi]], starts[i:j] - lo, ends[i:j] - lo)
        i = j
    return starts, ends, hashes


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The index of the string that each start lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words from each position, as far as there are n."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - n + 1 + k])
    return out


def release() -> None:
    """Give freed memory back to the system: worker processes are used again and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batches(stream, text: str, limit: int):
    """Arrow batches cut or joined so that each holds about ``limit`` bytes of ``text``, a row at least."""
    try:
        for k, part in enumerate(_cut(stream, text, limit)):
            yield part
            if k % 8 == 7:
                release()
    finally:
        release()


def _cut(stream, text: str, limit: int):
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in stream:
        if batch.num_rows == 0:
            continue
        column = batch.column(text)
        _, at = string_bytes(column)
        first = 0
        while first < batch.num_rows:
            room = limit - size
            last = int(np.searchsorted(at, at[first] + max(room, 0), "right")) - 1
            last = max(last, first + (0 if held else 1))
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(at[last] - at[first])
                first = last
            if first < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
