"""Vectorised text helpers shared by the corpus operators (numpy over Arrow buffers).

Everything here works on one Arrow batch inside a Spark task; Spark does the partitioning,
shuffling and aggregation.  Words are runs of bytes other than ASCII space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; it bounds the temporary arrays (about 60 bytes per byte of text).
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Each byte, with A to Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """The first n values of a fixed pseudo-random 64-bit sequence."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x1000003)) * step)


_BYTE = randoms(256, 11)
_PLACE = randoms(64, 12) | np.uint64(1)


def places(n: int) -> np.ndarray:
    """Odd multipliers for the places of a word; the table grows with the longest word seen."""
    global _PLACE
    if len(_PLACE) < n:
        _PLACE = randoms(2 * n, 12) | np.uint64(1)
    return _PLACE[:n]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places_, data = column.buffers()
    offsets = np.frombuffer(places_, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of `column` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, n in enumerate(lengths):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += int(n)
        yield batch.slice(start)


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Words:
    """Words of a batch: start, end (bytes), doc (row number) and a 64-bit hash of the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, separators: np.ndarray = _SPACE, hashed: bool = True):
        n = len(data)
        inside = ~separators[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = ~inside[:-1]
            after[:-1] = ~inside[1:]
            before |= cut[:n]
            after |= cut[1:]
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = np.zeros(0, np.uint64)
        if hashed and len(self.start):
            first, last = self.start[0], self.end[-1]
            place = np.arange(first, last, dtype=np.int64)
            gap = np.zeros(last - first, dtype=np.int64)
            gap[self.start - first] = np.diff(self.start, prepend=0)
            gap[0] = first
            place -= np.cumsum(gap)
            use = inside[first:last]
            place[~use] = 0
            part = data[first:last]
            value = _BYTE[LOWER[part] if lower else part]
            value *= places(int((self.end - self.start).max()))[place]
            value[~use] = 0
            self.hash = mix(np.add.reduceat(value, self.start - first) + (self.end - self.start).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number of the first word, hash) of every run of k words inside one document."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        total = np.zeros(len(first), dtype=np.uint64)
        for j, c in enumerate(randoms(k, 13) | np.uint64(1)):
            total += self.hash[first + j] * c
        return first, mix(total)


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as an Arrow column of Spark's long type."""
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
