"""Best-fit-decreasing packing into windows, with a segment tree to find the fullest window that has room.

Documents longer than a window are split without loss: full windows, then a rest. Rests are packed in blocks of
bounded size inside the task that tokenizes them, so nothing is shuffled and a block is all a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from studyspark.llm.word_tokens import END_ID, encoded_documents

WINDOW = 2048
#: Tokens packed together; of the last windows of a block, few are left part empty.
BLOCK_TOKENS = 1 << 22
PAD_ID = 0


class RoomTree:
    """Open windows by the room they have left: a segment tree over the rooms 0..most."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.leaves
        while node:
            self.count[node] += 1
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the least room that is at least ``need``."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node % 2 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node //= 2
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Items of each window: longest first (ties by position), each into the window it fills best. No length exceeds ``window``."""
    tree, windows = RoomTree(window), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[item])
        room, at = found or (window, len(windows))
        if found is None:
            windows.append([])
        windows[at].append(item)
        tree.put(room - lengths[item], at)
    return windows


def position_ids(bounds: np.ndarray, window: int) -> np.ndarray:
    """Positions that start again at each segment; padding has 0."""
    out = np.zeros(window, np.uint16 if window < 1 << 16 else np.uint32)
    for a, b in zip(bounds[:-1], bounds[1:]):
        out[a:b] = np.arange(b - a)
    return out


def pack(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
         end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, special: bool = False) -> DataFrame:
    """One row per window: sequence_id; ids, the padded row of the id matrix (little-endian 32-bit); n_tokens without
    padding; cu_seqlens, cumulative segment lengths from 0; position_ids (little-endian 16-bit, 32-bit for windows of
    65,536 and more); and per segment the document's id, its ids before the segment (starts) and doc_tokens.

    With ``special``, spelled special tokens get their own id, as by the library's default.
    A null text is empty and gives its end id alone. Repeated rows are packed as often as they come. Write the result
    before relying on sequence_id.
    """
    rows = documents.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    key = rows.schema[0]
    schema = StructType([
        StructField("sequence_id", LongType()), StructField("ids", BinaryType()), StructField("n_tokens", IntegerType()),
        StructField("cu_seqlens", ArrayType(IntegerType())), StructField("position_ids", BinaryType()),
        StructField("segment_ids", ArrayType(key.dataType)), StructField("starts", ArrayType(LongType())), StructField("doc_tokens", ArrayType(LongType()))])
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(key.dataType.simpleString())

    def rows_of(segments: list[tuple], groups: list[list[int]], first: int) -> pa.RecordBatch:
        """segments: (document key, start, ids, tokens of the document)."""
        columns: list[list] = [[] for _ in schema]
        for k, group in enumerate(groups):
            parts = [segments[i] for i in group]
            bounds = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])]).astype(np.int32)
            matrix_row = np.full(window, PAD_ID, "<u4")
            matrix_row[:bounds[-1]] = np.concatenate([p[2] for p in parts])
            row = (first + k, matrix_row.tobytes(), int(bounds[-1]), bounds, position_ids(bounds, window).tobytes(),
                   [p[0] for p in parts], [p[1] for p in parts], [p[3] for p in parts])
            for column, value in zip(columns, row):
                column.append(value)
        types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(key_type or pa.infer_type(columns[5]).value_type), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        rests: list[tuple] = []
        held = 0
        for keys, documents in encoded_documents(batches, path, end_id, special):
            full: list[tuple] = []
            for doc, ids in zip(keys.to_pylist(), documents):
                for at in range(0, len(ids), window):
                    part = ids[at:at + window]
                    (full if len(part) == window else rests).append((doc, at, part, len(ids)))
                    held += len(part) if len(part) < window else 0
            for a in range(0, len(full), 1024):
                yield rows_of(full[a:a + 1024], [[i] for i in range(len(full[a:a + 1024]))], first)
                first += len(full[a:a + 1024])
            if held >= block_tokens:
                yield from emit(rests, first)
                first += len(rests)          # at least as many as windows: ids stay unique
                rests, held = [], 0
        if rests:
            yield from emit(rests, first)

    def emit(rests: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        groups = best_fit([len(r[2]) for r in rests], window)
        for a in range(0, len(groups), 1024):
            yield rows_of(rests, groups[a:a + 1024], first + a)

    return rows.mapInArrow(run, schema)


def pieces(packed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per segment of packed windows: id, start, length, ids, doc_tokens, sequence_id, offset."""
    segment = """transform(sequence(1, size(segment_ids)), i -> struct(
        segment_ids[i - 1] AS id, starts[i - 1] AS start, cast(cu_seqlens[i] - cu_seqlens[i - 1] AS bigint) AS length,
        substring(ids, cu_seqlens[i - 1] * 4 + 1, (cu_seqlens[i] - cu_seqlens[i - 1]) * 4) AS ids,
        doc_tokens[i - 1] AS doc_tokens, cast(cu_seqlens[i - 1] AS bigint) AS offset))"""
    rows = packed.select("sequence_id", F.explode(F.expr(segment)).alias("p"))
    return rows.select(F.col("p.id").alias(id_column), "p.start", "p.length", "p.ids", "p.doc_tokens", "sequence_id", "p.offset")
