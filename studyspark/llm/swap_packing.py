"""Packing into as few windows as possible: best fit first, then a local search that exchanges documents between windows.

Documents longer than a window are cut into full windows and a rest. Rests are packed inside the task that tokenizes
them, in blocks of bounded size. The search moves documents between windows with room, or exchanges one for one or
two for one, always so that the sum of the squared fills grows: room gathers in few windows until these empty. It ends
where no exchange helps, where a lower bound shows that no window can be saved, or after some passes without success. The windows that keep room are
then gathered, by lengths only, into joint blocks and searched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from studyspark.llm.fit_packing import best_fit
from studyspark.llm.word_tokens import END_ID, encoded_documents
from studyspark.session import written

WINDOW = 4096
#: Tokens packed together in the tokenizing task.
BLOCK_TOKENS = 1 << 22
#: Windows searched together when those with room are gathered (only lengths are held).
JOINT_WINDOWS = 1 << 12
#: Windows, the emptiest first, whose pairs of documents are tried in place of one document of a fuller window.
PARTNERS = 8
#: The search goes through all windows with room again as long as that saves a window, and at most so often besides.
PATIENCE = 4
#: New places of up to so many pieces are sent to every task (some 60 bytes each); more are joined by a shuffle.
SENT_ROWS = 300_000


def least_windows(lengths: list[int] | np.ndarray, window: int) -> int:
    """A lower bound of the windows needed: for any k, items over window - k stand alone, items over half a window stand
    in different windows, and only the room these leave is open to items from k on."""
    count = np.bincount(np.asarray(lengths, np.int64), minlength=window + 1)[:window + 1]
    number, total = np.cumsum(count), np.cumsum(count * np.arange(window + 1))
    half, k = window // 2, np.arange(window // 2 + 1)
    alone = number[window] - number[window - k]
    shared, shared_sum = number[window - k] - number[half], total[window - k] - total[half]
    small = total[half] - np.r_[0, total][k]
    more = -((shared * window - shared_sum - small) // window)
    return int((alone + shared + np.maximum(more, 0)).max(initial=0))


class Windows:
    """Windows as multisets of lengths, with the items behind each length."""

    def __init__(self, lengths: list[int], groups: list[list[int]], window: int) -> None:
        self.window, self.lengths = window, lengths
        self.items: list[dict[int, list[int]]] = []
        for group in groups:
            held: dict[int, list[int]] = {}
            for i in group:
                held.setdefault(lengths[i], []).append(i)
            self.items.append(held)
        self.fill = np.array([sum(lengths[i] for i in g) for g in groups], np.int64)

    def _enter(self, w: int) -> None:
        for length in self.items[w]:
            self.holders[length][w] = None
            self.there[length] = True

    def _leave(self, w: int) -> None:
        for length in self.items[w]:
            del self.holders[length][w]
            self.there[length] = bool(self.holders[length])

    def _move(self, a: int, b: int, length: int) -> None:
        """One item of this length from window ``b`` to window ``a``."""
        held = self.items[b][length]
        self.items[a].setdefault(length, []).append(held.pop())
        if not held:
            del self.items[b][length]
        self.fill[a] += length
        self.fill[b] -= length

    def _swap(self, a: int, b: int, gives: tuple[int, ...], takes: tuple[int, ...]) -> None:
        self._leave(b)
        for length in takes:
            self._move(a, b, length)
        for length in gives:
            self._move(b, a, length)
        self._enter(b)

    def _one_taken(self, a: int) -> tuple[int, tuple[int, ...], int] | None:
        """(gain, lengths given, length taken): the best exchange of nothing, one or two documents for one of any window."""
        x = np.array(sorted(self.items[a]), np.int64)
        pairs = _pairs(x, self.items[a])
        given = np.concatenate([[0], x, pairs.sum(axis=1)])
        under = np.maximum.accumulate(np.where(self.there, np.arange(self.window + 1), 0))      # the greatest length that is there up to each
        gain = under[np.minimum(given + self.window - self.fill[a], self.window)] - given
        k = int(gain.argmax())
        if gain[k] <= 0:
            return None
        gives = () if k == 0 else (int(x[k - 1]),) if k <= len(x) else tuple(map(int, pairs[k - 1 - len(x)]))
        return int(gain[k]), gives, int(gain[k] + given[k])

    def _two_taken(self, a: int, b: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """(gain, lengths given, lengths taken): the best exchange of one document for two of window ``b``."""
        x, y = np.array(sorted(self.items[a]), np.int64), np.array(sorted(self.items[b]), np.int64)
        pairs = _pairs(y, self.items[b])
        if not len(pairs):
            return None
        pairs = pairs[np.argsort(pairs.sum(axis=1), kind="stable")]
        sums = pairs.sum(axis=1)
        at = np.searchsorted(sums, x + self.window - self.fill[a], "right") - 1            # the most that fits for what is given
        gain = np.where(at >= 0, sums[at] - x, 0)
        k = int(gain.argmax())
        return (int(gain[k]), (int(x[k]),), tuple(map(int, pairs[at[k]]))) if gain[k] > 0 else None

    def _fill_up(self, a: int, emptier: np.ndarray) -> bool:
        """Exchanges of ``a``, which is in no list of holders, with emptier windows as long as one fills it further."""
        helped = False
        while self.fill[a] < self.window:
            found = self._one_taken(a)
            if found:
                _, gives, take = found
                self._swap(a, next(iter(self.holders[take])), gives, (take,))
            else:
                tries = ((b, self._two_taken(a, b)) for b in emptier[self.fill[emptier] > 0][:PARTNERS].tolist())
                two = max(((t[0], -k, b, t) for k, (b, t) in enumerate(tries) if t), default=None)
                if two is None:
                    break
                self._swap(a, two[2], two[3][1], two[3][2])
            helped = True
        return helped

    def search(self, least: int) -> None:
        """Fill windows up, the fullest first, by exchanges with emptier ones: each raises the sum of the squared fills. Ends
        when ``least`` windows are left, no exchange helps, or ``PATIENCE`` passes have saved none."""
        left, waited = int((self.fill > 0).sum()), 0
        while left > least and waited < PATIENCE:
            open_ = sorted(np.flatnonzero((self.fill > 0) & (self.fill < self.window)).tolist(), key=lambda w: (self.fill[w], w))
            self.holders: list[dict[int, None]] = [{} for _ in range(self.window + 1)]
            self.there = np.zeros(self.window + 1, bool)
            for w in open_:                        # the emptiest holder of a length comes first
                self._enter(w)
            helped, waiting = False, np.array(open_, np.int64)
            while len(waiting) > 1:
                k = int(self.fill[waiting].argmax())
                a, waiting = int(waiting[k]), np.delete(waiting, k)
                self._leave(a)                     # for good in this pass: what waits is emptier
                if self.fill[a]:
                    helped |= self._fill_up(a, waiting)
            now = int((self.fill > 0).sum())
            waited, left = 0 if now < left else waited + 1, now
            if not helped:
                break

    def groups(self) -> list[list[int]]:
        return [[i for held in w.values() for i in held] for w, fill in zip(self.items, self.fill) if fill]


def _pairs(x: np.ndarray, held: dict[int, list[int]]) -> np.ndarray:
    """All pairs of lengths that a window holds at once."""
    a, b = np.triu_indices(len(x))
    twice = np.array([len(held[int(v)]) > 1 for v in x], bool)
    keep = (a != b) | twice[a]
    return np.stack([x[a[keep]], x[b[keep]]], axis=1)


def packed(lengths: list[int], window: int = WINDOW, groups: list[list[int]] | None = None) -> list[list[int]]:
    """Items of each window. Starts from ``groups`` if given, else from best fit. No length exceeds ``window``, none is 0."""
    groups = best_fit(lengths, window) if groups is None else groups
    least = least_windows(lengths, window)
    if len(groups) <= least:
        return groups
    windows = Windows(lengths, groups, window)
    windows.search(least)
    return windows.groups()


def _tokenized(documents: DataFrame, path: str, id_column: str, text_column: str, window: int, end_id: int, block_tokens: int, special: bool) -> DataFrame:
    """One row per piece, packed inside its task: id, piece, start, length, ids, and its first place: sequence_id, offset,
    n_tokens of that window."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    schema = StructType([rows.schema["id"], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType()),
                         StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("n_tokens", LongType())])

    def emit(key_type: pa.DataType, parts: list[tuple], groups: list[list[int]], first: int) -> pa.RecordBatch:
        """parts: (key, piece, start, ids)."""
        order = [i for g in groups for i in g]
        sizes = np.array([len(parts[i][3]) for i in order], np.int64)
        per = np.array([len(g) for g in groups])
        ends = np.cumsum(sizes)
        begin = np.r_[0, ends][np.cumsum(per) - per]                       # tokens before each window
        total = np.r_[0, ends][np.cumsum(per)] - begin
        numbers = first + np.repeat(np.arange(len(groups)), per)
        columns = [pa.array([parts[i][0] for i in order], key_type), pa.array([parts[i][1] for i in order], pa.int32()), pa.array([parts[i][2] for i in order], pa.int64()), pa.array(sizes),
                   pa.array([parts[i][3].astype("<u4").tobytes() for i in order], pa.binary()), pa.array(numbers), pa.array(ends - sizes - np.repeat(begin, per)), pa.array(np.repeat(total, per))]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, rests, held, key_type = TaskContext.get().partitionId() << 33, [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, rests, held
            groups = packed([len(r[3]) for r in rests], window)
            for a in range(0, len(groups), 256):
                yield emit(key_type, rests, groups[a:a + 256], first)
                first += len(groups[a:a + 256])
            rests, held = [], 0

        for keys, texts in encoded_documents(batches, path, end_id, special):
            key_type, full = keys.type, []
            for key, ids in zip(keys.to_pylist(), texts):
                for k, at in enumerate(range(0, len(ids), window)):
                    part = ids[at:at + window]
                    if len(part) == window:
                        full.append((key, k, at, part))
                    else:
                        rests.append((key, k, at, part.copy()))
                        held += len(part)
            for a in range(0, len(full), 256):
                some = full[a:a + 256]
                yield emit(key_type, some, [[i] for i in range(len(some))], first)
                first += len(some)
            if held >= block_tokens:
                yield from flush()
        if rests:
            yield from flush()

    return rows.mapInArrow(run, schema)


def _regrouped(open_: DataFrame, window: int, joint_windows: int, round_: int) -> DataFrame:
    """Windows with room, searched again in blocks of up to about ``joint_windows``: (sequence_id, offset) of each piece with its
    new_sequence and new_offset. The blocks differ from round to round."""
    n = open_.select("sequence_id").distinct().count()
    blocks = -(-n // joint_windows)
    dealt = open_.withColumn("block", F.pmod(F.xxhash64("sequence_id", F.lit(round_)), F.lit(blocks)))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        lengths = table.column("length").to_pylist()
        sequence = np.asarray(table.column("sequence_id"))
        starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        old = [list(range(a, b)) for a, b in zip(starts, np.r_[starts[1:], len(sequence)])]
        fresh = packed(lengths, window)
        groups = fresh if len(fresh) < len(old) else packed(lengths, window, old)
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for group, name in zip(groups, sequence[starts]):                  # no more windows than before: old numbers do
            at = 0
            for i in group:
                number[i], offset[i] = name, at
                at += lengths[i]
        return pa.table({"sequence_id": table.column("sequence_id"), "offset": table.column("offset"), "new_sequence": number, "new_offset": offset, "length": table.column("length")})

    return dealt.groupBy("block").applyInArrow(search, "sequence_id long, offset long, new_sequence long, new_offset long, length long")


def pack(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, end_id: int = END_ID,
         block_tokens: int = BLOCK_TOKENS, joint_windows: int = JOINT_WINDOWS, special: bool = False) -> DataFrame:
    """One row per piece: id, piece (from 0), start (the document's ids before it), length, ids (little-endian 32-bit),
    sequence_id, offset (its place there; gapless from 0).

    Only documents longer than a window are cut, into full windows and a rest. A null text is empty and gives its end
    id alone. Repeated rows are packed as often as they come, a null id stays null, other columns are ignored, and an
    empty table gives no row. Equal lengths are interchangeable; which of them shares a window with which is not fixed.
    """
    first = written(_tokenized(documents, path, id_column, text_column, window, end_id, block_tokens, special), "pieces")
    open_ = first.where(F.col("n_tokens") < window).select("sequence_id", "offset", "length")
    places, round_ = open_.select("sequence_id", "offset", F.col("sequence_id").alias("new_sequence"), F.col("offset").alias("new_offset"), "length"), 0
    windows = open_.select("sequence_id").distinct().count()
    while windows > 1:
        found = written(_regrouped(places.select(F.col("new_sequence").alias("sequence_id"), F.col("new_offset").alias("offset"), "length"), window, joint_windows, round_), "regrouped")
        moved = found.select(F.col("sequence_id").alias("new_sequence"), F.col("offset").alias("new_offset"), F.col("new_sequence").alias("s"), F.col("new_offset").alias("o"))
        places = written(places.join(moved, ["new_sequence", "new_offset"]).select("sequence_id", "offset", F.col("s").alias("new_sequence"), F.col("o").alias("new_offset"), "length"), "places")
        left, round_ = places.select("new_sequence").distinct().count(), round_ + 1
        if windows <= joint_windows or left > 0.99 * windows:              # one block saw all, or another round would save little
            break
        windows = left
    new = places.where("sequence_id <> new_sequence OR offset <> new_offset").drop("length")
    new = F.broadcast(new) if new.count() <= SENT_ROWS else new
    return first.join(new, ["sequence_id", "offset"], "left").select(
        F.col("id").alias(id_column), "piece", "start", "length", "ids",
        F.coalesce("new_sequence", "sequence_id").alias("sequence_id"), F.coalesce("new_offset", "offset").alias("offset"))
