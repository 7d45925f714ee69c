"""Byte-level BPE by merge ranks, in numpy: distinct pieces of a batch are merged together as padded matrices.

A text is cut by the split pattern, and each piece's bytes are merged: every round, each row of a matrix merges
its leftmost pair of least rank, until no pair of any row has a rank. Rows are bucketed by length, so padding
stays small. Pieces longer than a matrix row allows take the same steps with a heap, in n log n time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from studyspark.llm.batches import sliced

#: Longest piece, in bytes, that is merged as a matrix row.
ROW_BYTES = 128
#: Cells of one matrix.
MATRIX_CELLS = 1 << 20
#: Pieces remembered per worker before the memory starts afresh.
REMEMBERED = 400_000
_NONE = np.uint32(0xFFFFFFFF)


class PairTable:
    """Ranks of pairs of token ids in an open-addressing hash table: a lookup is a few gathers, whatever the size."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(1 << self.bits, _NONE)
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        values = np.fromiter(pairs.values(), np.uint32, len(pairs))
        slots = self._slots(keys)
        self.probes = 1
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.ranks[slots[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            if len(left):
                slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
                self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the greatest value where there is none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.ranks[slots], _NONE)
        open_ = np.flatnonzero((self.keys[slots] != keys) & (self.keys[slots] != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            here = self.keys[slots[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (here != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class ByteBpe:
    """Encoder and decoder of one rank file. A token's id is its rank."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.split = regex.compile(pattern)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.uint32)
        # Any cut of a token into two tokens is a pair that merges to it.
        self.pairs = PairTable({(self.ranks[t[:i]], self.ranks[t[i:]]): r for t, r in self.ranks.items()
                                for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[np.ndarray] = []

    def merge_rows(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row of a padded id matrix to the end; the merged matrix and its row sizes."""
        out, out_sizes = rows.copy(), sizes.copy()
        index = np.arange(len(rows))
        while len(index):
            width = int(sizes.max())
            rows = rows[:, :width]
            if width < 2:
                break
            inside = np.arange(width - 1) < (sizes - 1)[:, None]
            ranks = np.full(inside.shape, _NONE)
            ranks[inside] = self.pairs.look(rows[:, :-1][inside], rows[:, 1:][inside])
            at = ranks.argmin(1)                                    # the leftmost of equals
            best = ranks[np.arange(len(rows)), at]
            going = best != _NONE
            stop = ~going
            out[index[stop], :width], out_sizes[index[stop]] = rows[stop], sizes[stop]
            rows, sizes, index, at, best = rows[going], sizes[going] - 1, index[going], at[going], best[going]
            if not len(index):
                return out, out_sizes
            columns = np.arange(width - 1)
            rows = np.where(columns <= at[:, None], rows[:, :-1], rows[:, 1:])   # closes the gap
            rows[np.arange(len(rows)), at] = best
        out[index, :rows.shape[1]], out_sizes[index] = rows, sizes
        return out, out_sizes

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, by a heap of (rank, position) over linked neighbours."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        first = self.pairs.look(np.array(ids[:-1], np.uint32), np.array(ids[1:], np.uint32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                token = self.ranks.get(self.bytes[ids[i]] + self.bytes[ids[j]])
                if token is not None:
                    heapq.heappush(heap, (token, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = rank, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return np.array([x for x, there in zip(ids, alive) if there], np.uint32)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece (not empty)."""
        out: list[np.ndarray] = [None] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(sizes, kind="stable")
        order, long = order[sizes[order] <= ROW_BYTES], order[sizes[order] > ROW_BYTES]
        at = 0
        while at < len(order):
            width = int(sizes[order[at]])
            bucket = order[at:int(np.searchsorted(sizes[order], width + width // 4, "right"))]
            bucket = bucket[:max(1, MATRIX_CELLS // max(1, int(sizes[bucket[-1]])))]
            size, widest = sizes[bucket], int(sizes[bucket[-1]])
            rows = np.zeros((len(bucket), widest), np.uint32)
            rows[np.arange(widest) < size[:, None]] = self.byte_ids[np.frombuffer(b"".join([pieces[i] for i in bucket]), np.uint8)]
            merged, size = self.merge_rows(rows, size)
            for i, row, n in zip(bucket, merged, size):
                out[i] = row[:n].copy()
            at += len(bucket)
        for i in long:
            out[i] = self.merge_long(pieces[i])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = [self.split.findall(t) for t in texts]
        new = list(dict.fromkeys(p for pieces in split for p in pieces if p not in self.known))
        for piece, ids in zip(new, self.merge([p.encode("utf-8", "surrogatepass") for p in new])):
            self.known[piece] = len(self.ids)
            self.ids.append(ids)
        empty, known, ids = np.zeros(0, np.uint32), self.known, self.ids
        return [np.concatenate([ids[known[p]] for p in pieces]) if pieces else empty for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode(documents: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, n_tokens) per row; ids as little-endian 32-bit integers. A null text is empty and has no ids. Extra
    columns are left out; repeated rows give repeated results."""
    rows = documents.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    schema = StructType([rows.schema[0], StructField("ids", BinaryType()), StructField("n_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for batch in sliced(batches, "text"):
            ids = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                                              pa.array([len(i) for i in ids], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded, decoded_sha256): the bytes that the ids stand for and hex digests of both.
    Null ids decode to no bytes; an id outside the vocabulary raises IndexError."""
    schema = StructType([encoded.schema[id_column], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                         StructField("decoded", BinaryType()), StructField("decoded_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for batch in sliced(batches, "ids"):
            ids = [b or b"" for b in batch.column("ids").to_pylist()]
            texts = [coder.decode(np.frombuffer(b, "<u4")) for b in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in ids]),
                 pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=schema.names)

    return encoded.select(F.col(id_column), "ids").mapInArrow(run, schema)
