"""Arrow batches of texts: bounded slices, word bounds and hashes as numpy arrays.

Words are maximal runs of characters other than space and the controls 9-13. Hashes are 64 bits wide: a
polynomial over the bytes with a fixed odd base, then a bit mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; bounds the temporary arrays to some 40 times as much.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most ``most`` bytes in ``column``; a longer value makes a slice of its own."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        first, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += int(size)
        if first < batch.num_rows:
            yield batch.slice(first)
    give_back()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offset of each row (one more than rows). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the machine: an idle worker would else keep the most that a task of it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; spans ascend and don't overlap. Works through the bytes in pieces of bounded size."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(int(np.searchsorted(ends, base + SLICE_BYTES, "right")), first + 1)
        part = data[base:int(ends[last - 1])]
        with np.errstate(over="ignore"):
            powers = np.full(len(part) + 1, _UP)
            powers[0] = 1
            powers = np.cumprod(powers)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * powers[:-1], out=sums[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            back = np.full(len(part) + 1, _DOWN)
            back[0] = 1
            back = np.cumprod(back)
            out[first:last] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        first = last
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one more than rows)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = inside[1:-1][edges]          # a word never runs on into the next row
    end[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; the last n - 1 positions have none."""
    count = max(len(words) - n + 1, 0)
    acc = np.full(count, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            acc = acc * _UP + words[k:k + count]
        return mix(acc)


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row's range of positions."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
