"""Packing by exchanges against the best packing of small cases, lower bounds and the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from studyspark.llm.fit_packing import best_fit
from studyspark.llm.swap_packing import Windows, least_windows, pack, packed

WORDS = public_tokenizers.path("word_bpe_49k.json")


def _optimum(lengths, window):
    """Fewest windows, by trying all ways."""
    best = len(lengths)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for k in range(len(fills)):
            if fills[k] + lengths[i] <= window:
                place(i + 1, fills[:k] + [fills[k] + lengths[i]] + fills[k + 1:])
        place(i + 1, fills + [lengths[i]])
    place(0, [])
    return best


def _sound(groups, lengths, window):
    return sorted(i for g in groups for i in g) == list(range(len(lengths))) and all(0 < sum(lengths[i] for i in g) <= window for g in groups)


@pytest.mark.parametrize("seed", range(60))
def test_between_bound_and_best_fit(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 10, 16, 31])
    lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(1, 9))), reverse=True)
    groups, best = packed(lengths, window), _optimum(lengths, window)
    assert _sound(groups, lengths, window)
    assert least_windows(lengths, window) <= best <= len(groups) <= len(best_fit(lengths, window))


def test_bound_counts_what_cannot_share():
    assert least_windows([], 10) == 0 and least_windows([6] * 5, 10) == 5 and least_windows([6, 6, 5, 5, 4], 10) == 3
    assert least_windows([3000] * 9 + [1200] * 4, 4096) == 11 and least_windows([10] * 3 + [1], 10) == 4


@pytest.mark.parametrize("old, lengths", [
    ([[0, 1], [2]], [6, 2, 2]),                               # a move
    ([[0, 1], [2, 3]], [5, 2, 3, 2]),                         # one for one
    ([[0, 1, 2], [3, 4], [5]], [4, 2, 2, 5, 2, 1]),           # two for one
])
def test_exchanges_raise_squared_fill(old, lengths):
    w = Windows(lengths, old, 10)
    before = int((w.fill ** 2).sum())
    w.search(least=1)
    assert _sound(w.groups(), lengths, 10) and int((w.fill ** 2).sum()) > before


def test_search_empties_windows_that_best_fit_leaves():
    better = 0
    for seed in range(8):
        rng = random.Random(seed)
        lengths = [rng.randint(600, 2100) for _ in range(200)]
        groups = packed(lengths, 4096)
        assert _sound(groups, lengths, 4096) and len(groups) <= len(best_fit(lengths, 4096))
        better += len(groups) < len(best_fit(lengths, 4096))
    assert better > 0


@pytest.mark.parametrize("block_tokens, joint, window", [(1 << 22, 1 << 12, 4096), (300, 2, 64), (1, 1 << 12, 64)])
def test_pack_on_spark(spark, block_tokens, joint, window):
    rng = random.Random(5)
    texts = ["", None, "word " * 700, "a<|endoftext|>b"] + [" ".join(rng.choice(["alpha", "be", "c", "delta-x", "éa"]) for _ in range(rng.randrange(1, 60))) for _ in range(8)] + ["same text"] * 60
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS piece").repartition(5, "doc_id")
    got = pack(docs, WORDS, window=window, block_tokens=block_tokens, joint_windows=joint, special=True).collect()
    library = Tokenizer.from_file(WORDS)
    want = sorted((np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes(), -1 if i is None else i) for i, t in rows)
    parts = {}
    for r in sorted(got, key=lambda r: (r.piece, r.start)):
        assert r.start == r.piece * window and r.length == len(r.ids) // 4 <= window
        parts.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(bytes(r.ids))
    assert sorted((b"".join(p), i) for i, p in parts.items() if i != 7) == [w for w in want if w[1] != 7]
    assert sorted(parts[7]) == [w[0] for w in want if w[1] == 7]
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    if joint > 2:
        assert len(sequences) == least_windows([r.length for r in got], window)


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0
