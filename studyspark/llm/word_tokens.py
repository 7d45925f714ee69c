"""Token ids of whole texts by a word tokenizer file, on Spark: each distinct word is merged once per worker.

The tokenizer drops white space, so a text's ids are those of its words one after another. Words are found and hashed
as numpy arrays and looked up in a table of hashes; Python sees only words that the table does not hold. A word of Latin-1
characters is cut and merged through the tokenizer's own model; any other goes through the whole tokenizer, and so
does, with ``special``, a word in which a special token is spelled: the library then reads it as that token's one id.
Without ``special`` such strings are ordinary text, so no document can forge a control token.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer

from studyspark.llm.batches import bytes_of, give_back, sliced, span_hashes, word_bounds

#: Words remembered per task (some 50 bytes each) before that memory starts afresh.
REMEMBERED = 1_000_000
#: Parts of words remembered in each of two generations.
PARTS = 150_000
#: Longer words are told apart by their bytes, not by a hash, and forgotten with their batch.
LONG_WORD = 64
#: Words looked up at once.
CHUNK = 1 << 18
#: The id that ends each document.
END_ID = 1

# The tokenizer file's split pattern, spelled out for lower-case Latin-1 text.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\x09-\x0d\x20\x85\xa0{_LETTER}{_NUMBER}]+")


def _byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class HashTable:
    """Codes of 64-bit hashes, with open addressing; at most half full. Lookups and insertions take whole arrays."""

    def __init__(self, most: int) -> None:
        bits = (2 * most - 1).bit_length()
        self.keys = np.zeros(1 << bits, np.uint64)
        self.codes = np.full(1 << bits, -1, np.int32)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash, -1 where it is unknown."""
        at = self._home(hashes)
        out = self.codes[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            codes = self.codes[at]
            out[left] = codes
            go_on = (codes >= 0) & (self.keys[at] != hashes[left])
            left, at = left[go_on], at[go_on]
        return out

    def add(self, hashes: np.ndarray, codes: np.ndarray) -> None:
        """Enter distinct hashes that are not in the table."""
        at = self._home(hashes)
        while len(hashes):
            free = self.codes[at] < 0
            self.keys[at[free]] = hashes[free]        # of several that want one slot, the last one gets it
            got = free & (self.keys[at] == hashes)
            self.codes[at[got]] = codes[got]
            hashes, codes, at = hashes[~got], codes[~got], (at[~got] + 1) & self.mask


class WordEncoder:
    """Ids of texts. Remembers the ids of words and of their parts, as plain bytes."""

    def __init__(self, path: str, special: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        spelled = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.spelled = re.compile("|".join(spelled) or "(?!)")
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.release()

    def release(self) -> None:
        """Let go of all that was learned."""
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table: HashTable | None = None
        self.ids, self.bounds = bytearray(), array("q", [0])

    def forget(self) -> None:
        self.table = HashTable(REMEMBERED)
        self.known = 0
        self.ids = bytearray()
        self.bounds = array("q", [0])

    def _part(self, part: str) -> bytes:
        """Ids of a part that is not in the younger generation."""
        known = self.older.get(part)
        if known is None:
            letters = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(self.letters)
            known = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(self.parts) >= PARTS:      # parts in use pass over to the younger generation
            self.older, self.parts = self.parts, {}
        self.parts[part] = known
        return known

    def _learn(self, word: str) -> None:
        """Append the ids of a word."""
        if (word.isascii() or max(word) <= "\xff") and not self.spelled.search(word):
            for part in _PART.findall(word.lower()):
                self.ids += self.parts.get(part) or self._part(part)
        else:
            self.ids += array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self.bounds.append(len(self.ids) // 4)

    def _codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The code of each word: its place in ``bounds``."""
        hashes, short = span_hashes(data, starts, ends), ends - starts <= LONG_WORD
        codes = self.table.find(hashes)
        new, first = np.unique(hashes[short & (codes < 0)], return_index=True)
        if self.known + len(new) > REMEMBERED:
            self.forget()
            codes[:] = -1
            new, first = np.unique(hashes[short], return_index=True)
        first = np.flatnonzero(short & (codes < 0))[first]
        self.table.add(new, np.arange(len(self.bounds) - 1, len(self.bounds) - 1 + len(new), dtype=np.int32))
        self.known += len(new)
        for a, b in zip(starts[first].tolist(), ends[first].tolist()):
            self._learn(str(data[a:b], "utf-8"))
        codes = self.table.find(hashes)
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(~short):
            word = data[starts[i]:ends[i]].tobytes()
            if word not in seen:
                seen[word] = len(self.bounds) - 1
                self._learn(word.decode())
            codes[i] = seen[word]
        return codes

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more than texts). Null is empty."""
        if self.table is None:
            self.forget()
        data, offsets = bytes_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        starts, ends, before = word_bounds(data, offsets)
        pieces, at, total, step = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0, min(CHUNK, REMEMBERED)
        for k in range(0, len(starts), step):
            codes = self._codes(data, starts[k:k + step], ends[k:k + step])
            bounds = np.frombuffer(self.bounds, np.int64)
            first, sizes = bounds[codes], bounds[codes + 1] - bounds[codes]
            end = np.cumsum(sizes)
            pieces.append(np.frombuffer(self.ids, np.uint32)[np.repeat(first - (end - sizes), sizes) + np.arange(end[-1])])
            at.append(end + total)
            total += int(end[-1])
            del bounds                       # a view would keep the memory from growing
            if len(self.bounds) > 2 * REMEMBERED:
                self.forget()                # long words are learned anew each time
        return np.concatenate(pieces), np.concatenate(at)[before]


@lru_cache(maxsize=2)
def word_encoder(path: str, special: bool = False) -> WordEncoder:
    return WordEncoder(path, special)


def encoded_documents(batches: Iterator[pa.RecordBatch], path: str, end_id: int, special: bool = False) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """For each bounded slice of (id, text) rows: the ids column and each row's token ids with the end id."""
    encoder = word_encoder(path, special)
    for batch in sliced(batches, "text"):
        ids, bounds = encoder.encode(batch.column("text"))
        end = np.array([end_id], np.uint32)
        yield batch.column(0), [np.concatenate([ids[a:b], end]) for a, b in zip(bounds[:-1], bounds[1:])]
    encoder.release()       # the worker stays for tasks of other kinds
    give_back()


def tokenize(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID,
             special: bool = False) -> DataFrame:
    """(id, ids, n_tokens, part, before) per row: ids as little-endian 32-bit integers ending in ``end_id``, the
    task that made the row, and the tokens before it in that task. Write the result before relying on part and before.
    With ``special``, spelled special tokens get their own id, as by the library's default."""
    rows = documents.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    schema = StructType([rows.schema[0], StructField("ids", BinaryType()), StructField("n_tokens", LongType()),
                         StructField("part", IntegerType()), StructField("before", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for keys, documents in encoded_documents(batches, path, end_id, special):
            sizes = np.array([len(d) for d in documents], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array([d.astype("<u4").tobytes() for d in documents], pa.binary()), pa.array(sizes),
                 pa.array(np.full(len(sizes), part, np.int32)), pa.array(starts)], names=schema.names)

    return rows.mapInArrow(run, schema)
