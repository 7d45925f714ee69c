"""Katz backoff scores of texts: a bigram model with Good-Turing discounts, counted and evaluated as Spark tables.

Documents are encoded in blocks. A block sends its distinct words and word pairs, already counted, to the buckets of
the second word; a bucket adds up the counts of all blocks, answers every block with the totals of its own pairs, and
passes on what the backoff weights need of each first word. Blocks then score seen pairs themselves and ask the
buckets of the first words for the weights of the rest. Nothing is shuffled per token.

The model, over training tokens (words and ends; each text begins in a start state):

* P1(w) = d(c) c / N for a word counted c times. What the discounts leave, P0, goes to one symbol for all unseen words.
* P(w | v) = d(c) c / C(v) if the pair was counted c times, else a(v) P1(w), where C(v) is the count of v as first word and
  a(v) = (1 - sum of the seen P(w | v)) / (1 - sum of P1(w) over the same w), which makes the sum over all words exactly 1.
  Where v was never seen, P(w | v) = P1(w).
* d(r) for r <= 5 is Katz's Good-Turing discount from the counts of counts, for words and pairs apart; where these don't
  give a number between 0 and 1 for every r, and beyond 5, half a count is taken off: d(c) = (c - 0.5) / c.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from studyspark.llm.batches import bytes_of, give_back, lowered, sliced, span_hashes, word_bounds
from studyspark.session import release_shuffles, written

#: Largest count with a Good-Turing discount of its own.
K = 5
#: Text bytes encoded as one block.
BLOCK_BYTES = 8 << 20
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64- or 32-bit unsigned integers, compressed one by one."""
    out = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        squeezed = pa.compress(np.ascontiguousarray(a).tobytes(), "zstd", asbytes=True) if len(a) else b""
        out += [np.array([a.itemsize, len(a), len(squeezed)], np.uint32).tobytes(), squeezed]
    return b"".join(out)


def unpack(payload: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(int(np.frombuffer(payload, np.uint32, 1)[0])):
        size, count, length = (int(x) for x in np.frombuffer(payload, np.uint32, 3, at))
        raw = pa.decompress(payload[at + 12:at + 12 + length], size * count, "zstd", asbytes=True) if count else b""
        out.append(np.frombuffer(raw, np.uint64 if size == 8 else np.uint32))
        at += 12 + length
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets ascend with the hash, so those of sorted hashes are slices."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Pairs:
    """The distinct (first, second) pairs of a block's tokens, ordered by the second's bucket, then first, then second."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, lengths: np.ndarray, buckets: int) -> None:
        k = len(keys)
        first = np.empty(len(codes), np.uint64)
        first[1:] = codes[:-1]
        first[np.cumsum(lengths) - lengths] = k                      # the start state
        bucket = bucket_of(keys, buckets)
        packed = (bucket[codes] * np.uint64(k + 1) + first) * np.uint64(k) + codes.astype(np.uint64)
        unique, self.of_token = np.unique(packed, return_inverse=True)
        self.second = (unique % np.uint64(k)).astype(np.int64)
        self.first = ((unique // np.uint64(k)) % np.uint64(k + 1)).astype(np.int64)
        self.word_cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        self.pair_cuts = np.searchsorted(bucket[self.second], np.arange(buckets + 1))


def _blocks(documents: DataFrame) -> DataFrame:
    """(block, payload, ids, held): the distinct words, token codes and text lengths of each block of documents."""
    schema = StructType([StructField("block", LongType()), StructField("payload", BinaryType()),
                         StructField("ids", ArrayType(documents.schema["id"].dataType)), StructField("held", ArrayType(BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "text", BLOCK_BYTES):
            data, offsets = bytes_of(batch.column("text"))
            data = lowered(data)
            starts, ends, rows = word_bounds(data, offsets)
            docs = np.arange(batch.num_rows)
            tokens = np.empty(len(starts) + len(docs), np.uint64)
            tokens[np.arange(len(starts)) + np.repeat(docs, np.diff(rows))] = span_hashes(data, starts, ends)
            tokens[rows[1:] + docs] = END
            keys, codes = np.unique(tokens, return_inverse=True)
            payload = pack(keys, codes.astype(np.uint32), (np.diff(rows) + 1).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([payload], pa.binary()),
                pa.array([batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([batch.column("held").to_pylist()], pa.list_(pa.bool_()))], names=schema.names)
            block += 1

    return documents.mapInArrow(run, schema)


def _sent(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, payload): the pairs of each block and their training counts, per bucket of the second word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, held in zip(*(batch.column(c) for c in ("block", "payload", "held"))):
                keys, codes, lengths = unpack(payload.as_py())
                pairs = Pairs(keys, codes.astype(np.int64), lengths.astype(np.int64), buckets)
                train = ~np.repeat(np.array(held.as_py(), bool), lengths)
                counts = np.bincount(pairs.of_token[train], minlength=len(pairs.first)).astype(np.uint32)
                names = np.append(keys, START)
                sides, payloads = [], []
                for b in range(buckets):
                    w, p = slice(*pairs.word_cuts[b:b + 2]), slice(*pairs.pair_cuts[b:b + 2])
                    if w.start < w.stop:
                        firsts, runs = np.unique(pairs.first[p], return_counts=True)
                        sides.append(b)
                        payloads.append(pack(keys[w], names[firsts], runs.astype(np.uint32), (pairs.second[p] - w.start).astype(np.uint32), counts[p]))
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(sides), pa.int64()), pa.array(sides, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "bucket", "payload"])
        give_back()

    return blocks.select("block", "payload", "held").mapInArrow(run, "block long, bucket int, payload binary")


def _classes(counts: np.ndarray) -> np.ndarray:
    """1..K for counts up to K, K + 1 for the rest; 0 for none."""
    return np.minimum(counts, K + 1).astype(np.int64)


def _totals(buckets: int):
    """For one bucket of second words: answers to blocks, parts of the backoff weights by bucket of first word, counts of counts."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        give_back()         # what the last group left
        parts = [unpack(p) for p in group["payload"]]
        words, word_of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        firsts, first_of = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        word_at = np.cumsum([0] + [len(p[0]) for p in parts])
        pair_at = np.cumsum([0] + [len(p[3]) for p in parts])
        second = np.concatenate([word_of[a + p[3]] for a, p in zip(word_at, parts)])
        first = np.repeat(first_of, np.concatenate([p[2] for p in parts]))
        unique, pair_of = np.unique(first.astype(np.uint64) * np.uint64(len(words)) + second.astype(np.uint64), return_inverse=True)
        total = np.bincount(pair_of, np.concatenate([p[4] for p in parts]), len(unique)).astype(np.int64)
        second = (unique % np.uint64(len(words))).astype(np.int64)
        count = np.bincount(second, total, len(words)).astype(np.int64)
        rows = [("answer", int(block), int(group["bucket"].iloc[0]), pack(count[word_of[word_at[i]:word_at[i + 1]]].astype(np.uint64), total[pair_of[pair_at[i]:pair_at[i + 1]]].astype(np.uint64)))
                for i, block in enumerate(group["block"])]
        shape = [np.bincount(_classes(c), minlength=K + 2)[1:] for c in (count, total)]
        all_of = [np.bincount(np.minimum(c, K + 2), minlength=K + 3)[K + 1] for c in (count, total)]      # those of exactly K + 1
        at = np.searchsorted(words, END)
        ends = int(count[at]) if at < len(words) and words[at] == END else 0
        rows.append(("stats", None, None, pack(np.concatenate([shape[0][:K], [all_of[0]], shape[1][:K], [all_of[1]], [count.sum(), (count > 0).sum(), shape[0].sum() - shape[0][:K].sum(), ends]]).astype(np.uint64))))
        seen = np.flatnonzero(total)
        if len(seen):
            owner = (unique[seen] // np.uint64(len(words))).astype(np.int64)
            owners, owner = np.unique(owner, return_inverse=True)
            table = [firsts[owners], np.bincount(owner, total[seen]).astype(np.uint64)]
            for values in (total[seen], count[second[seen]]):
                kind = _classes(values)
                table += [np.bincount(owner[kind == r], minlength=len(owners)).astype(np.uint32) for r in range(1, K + 2)]
                table.append(np.bincount(owner[kind > K], values[kind > K], len(owners)).astype(np.uint64))
            cuts = np.searchsorted(bucket_of(table[0], buckets), np.arange(buckets + 1))
            rows += [("weight", None, b, pack(*[c[cuts[b]:cuts[b + 1]] for c in table])) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        return pd.DataFrame(rows, columns=["kind", "block", "bucket", "payload"]).astype({"block": "Int64", "bucket": "Int32"})

    return run


def discounts(counts: list[int]) -> list[float]:
    """d(1..K) from the numbers of things counted 1..K + 1 times."""
    half = [(r - 0.5) / r for r in range(1, K + 1)]
    if min(counts[:K]) <= 0:
        return half
    last = (K + 1) * counts[K] / counts[0]
    out = [((r + 1) * counts[r] / (r * counts[r - 1]) - last) / (1 - last) if last != 1 else -1.0 for r in range(1, K + 1)]
    return out if all(0 < d < 1 for d in out) else half


class Model:
    """The numbers that every task needs: discounts and totals."""

    def __init__(self, stats: np.ndarray) -> None:
        one, two = stats[:K + 1].tolist(), stats[K + 1:2 * K + 2].tolist()
        self.tokens, self.types, many, self.ends = (int(x) for x in stats[2 * K + 2:])
        self.word, self.pair = np.array([0.0, *discounts(one)]), np.array([0.0, *discounts(two)])
        taken = sum(n * r * (1 - self.word[r]) for r, n in enumerate(one[:K], 1)) + 0.5 * many
        self.unseen = taken / self.tokens if self.tokens else 1.0

    @staticmethod
    def _kept(counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        return np.where(counts > K, counts - 0.5, counts * table[np.minimum(counts, K)])

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self._kept(counts, self.word) / max(self.tokens, 1), self.unseen)

    def pair_mass(self, counts: np.ndarray) -> np.ndarray:
        return self._kept(counts, self.pair)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _scored(model: Model, buckets: int):
    """For one block: each document's figures, and what it asks of the buckets of first words."""
    def run(state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "bucket", "payload", "n_tokens", "n_known", "base", "part"]
        if state.empty:
            return pd.DataFrame(columns=columns, dtype=object)
        give_back()         # what the last block left
        keys, codes, lengths = unpack(state["payload"].iloc[0])
        codes = codes.astype(np.int64)
        pairs = Pairs(keys, codes, lengths.astype(np.int64), buckets)
        parts = [unpack(p) for p in answers.sort_values("bucket")["payload"]]
        count, total = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (0, 1))
        context = np.append(count, model.ends)[pairs.first]
        seen = total > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.log10(np.where(seen, model.pair_mass(total) / np.maximum(context, 1), model.p1(count)[pairs.second]))
        docs = np.repeat(np.arange(len(lengths)), lengths)

        def per_document(values: np.ndarray) -> np.ndarray:
            return np.bincount(docs, values, len(lengths))
        block = int(state["block"].iloc[0])
        rows = [(block, None, None, lengths.astype(np.int64), per_document((count > 0)[codes]).astype(np.int64), per_document(model.base(count)[codes]), per_document(logs[pairs.of_token]))]
        open_ = np.flatnonzero((~seen & (context > 0))[pairs.of_token])
        if len(open_):
            names = np.append(keys, START)[pairs.first[pairs.of_token[open_]]]
            order = np.argsort(names, kind="stable")
            names, asking = names[order], docs[open_][order].astype(np.uint32)
            cuts = np.searchsorted(bucket_of(names, buckets), np.arange(buckets + 1))
            rows += [(block, b, pack(names[cuts[b]:cuts[b + 1]], asking[cuts[b]:cuts[b + 1]]), None, None, None, None) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        return pd.DataFrame(rows, columns=columns).astype({"bucket": "Int32"})

    return run


def _weighed(model: Model):
    """For one bucket of first words: the logarithms of backoff weights, summed per asking document."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks, known = group[group["kind"] == "ask"], group[group["kind"] == "weight"]
        if asks.empty:
            return pd.DataFrame(columns=["block", "docs", "logs"], dtype=object)
        columns = [np.concatenate(c) for c in zip(*[unpack(p) for p in known["payload"]])]
        names, of = np.unique(columns[0], return_inverse=True)
        sums = [np.bincount(of, c.astype(np.float64), len(names)) for c in columns[1:]]
        pairs, words = sums[1:K + 3], sums[K + 3:]

        def mass(parts: list[np.ndarray], table: np.ndarray) -> np.ndarray:
            return sum(r * table[r] * parts[r - 1] for r in range(1, K + 1)) + parts[K + 1] - 0.5 * parts[K]
        logs = np.log10((1 - mass(pairs, model.pair) / sums[0]) / (1 - mass(words, model.word) / model.tokens))
        rows = []
        for block, payload in zip(asks["block"], asks["payload"]):
            wanted, docs = unpack(payload)
            each, where = np.unique(docs, return_inverse=True)
            rows.append((int(block), each.astype(np.int64), np.bincount(where, logs[np.searchsorted(names, wanted)], len(each))))
        return pd.DataFrame(rows, columns=["block", "docs", "logs"])

    return run


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """The sums of one block's documents over all buckets, by the document's place in the block."""
    docs, logs = np.concatenate(group["docs"].to_list()), np.concatenate(group["logs"].to_list())
    return pd.DataFrame({"b": [int(group["block"].iloc[0])], "more": [np.bincount(docs, logs)]})


def score(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose id's CRC-32 (of the id as text) leaves 1 modulo 5 are held out; the others train, as do rows without id.
    A null or empty text is one end token. Repeated rows count and score as often as they come. Without training
    rows all words are unseen and every score is 0. Extra columns are left out.
    """
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), held.alias("held"))
    blocks = written(_blocks(rows), "blocks")
    totals = written(_sent(blocks, buckets).groupBy("bucket").applyInPandas(_totals(buckets), "kind string, block long, bucket int, payload binary"), "totals")
    release_shuffles(spark)         # that of the pairs is the largest
    stats = [unpack(r["payload"])[0] for r in totals.where("kind = 'stats'").select("payload").collect()]     # a few numbers per bucket
    model = Model(np.sum(stats, axis=0) if stats else np.zeros(2 * K + 6, np.int64))

    out = StructType([StructField("block", LongType()), StructField("bucket", IntegerType()), StructField("payload", BinaryType()),
                      StructField("n_tokens", ArrayType(LongType())), StructField("n_known", ArrayType(LongType())), StructField("base", ArrayType(DoubleType())), StructField("part", ArrayType(DoubleType()))])
    answers = totals.where("kind = 'answer'").select("block", "bucket", "payload")
    scored = written(blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_scored(model, buckets), out), "scored")
    asks = scored.where("bucket IS NOT NULL").select(F.lit("ask").alias("kind"), "block", "bucket", "payload")
    weights = totals.where("kind = 'weight'").select("kind", F.lit(None).cast("long").alias("block"), "bucket", "payload")
    more = asks.unionByName(weights).groupBy("bucket").applyInPandas(_weighed(model), "block long, docs array<long>, logs array<double>")
    more = more.groupBy("block").applyInPandas(_summed, "b long, more array<double>")
    named = blocks.select(F.col("block").alias("s"), "ids", "held")
    docs = scored.where("bucket IS NULL").join(named, F.col("block") == F.col("s")).join(more, F.col("block") == F.col("b"), "left") \
        .select(F.explode(F.arrays_zip("ids", "held", "n_tokens", "n_known", "base", "part", F.coalesce("more", F.array().cast("array<double>")).alias("more"))).alias("x")).select("x.*")
    return docs.select(
        F.col("ids").alias(id_column), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))
