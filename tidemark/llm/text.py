"""Small array helpers used inside tasks: batches by size, words and shingles as 64-bit hashes.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, on UTF-8 bytes. A word's
hash is a polynomial over substituted bytes, mixed; a shingle's hash mixes the hashes of its
words. Sets are compared by these hashes; within one pair of documents a collision has a chance
of about 1e-11 for sets of 10,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


# One random 64-bit value for each byte; upper-case letters share that of their lower case.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def sized(batches: Iterator[pa.RecordBatch], column: str = "text",
          limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``column`` or one row. After the
    last one, memory that Arrow holds unused is given back, as workers outlive their tasks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0)
        total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the offset of each row's first word (rows + 1). Without
    ``fold`` the case of A-Z counts."""
    data, offsets = utf8(column)
    rows = len(offsets) - 1
    # A blank after each row keeps words of neighbours apart.
    data = np.insert(data, offsets[1:], 32)
    offsets = offsets + np.arange(rows + 1)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    ends = np.flatnonzero(edge == -1)
    length = ends - starts
    where = np.flatnonzero(inside)
    first = np.cumsum(length) - length
    within = np.arange(len(where)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(length.max()), _STEP, dtype=np.uint64))
        values = (_BYTE if fold else _CASED)[data[where]] * power[within]
        hashes = mix64(np.add.reduceat(values, first) + length.astype(np.uint64) * _STEP)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles: with fewer words
    the whole sequence is one shingle, without words the set is empty."""
    words, offsets = word_hashes(column)
    with np.errstate(over="ignore"):
        count = max(0, len(words) - width + 1)
        mixed = np.full(count, np.uint64(width))
        for k in range(width):
            mixed = mix64(mixed * _STEP + words[k:k + count])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = b - a
        if n >= width:
            yield np.unique(mixed[a:b - width + 1])
        elif n == 0:
            yield np.zeros(0, np.uint64)
        else:
            short = np.full(1, np.uint64(n))
            with np.errstate(over="ignore"):
                for k in range(n):
                    short = mix64(short * _STEP + words[a + k:a + k + 1])
            yield short
