"""Byte-level BPE, token packing, archives and the pipeline against libraries, round trips and brute force."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from studyspark.llm import word_tokens
from studyspark.llm.byte_bpe import ByteBpe, decode, encode
from studyspark.llm.cut_packing import cut, windows
from studyspark.llm.fit_packing import best_fit, pack, pieces
from studyspark.llm.warc import read_archives, read_records, record, with_revisits, write_archives
from studyspark.session import scratch_path, written

RANKS, PATTERN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a" * 3000, "  \n\n x", "ééé" * 100, "<|endoftext|>", "😀" * 60, "=" * 700, " " * 333, "\x1cab\x85c\xa0d", "I'LL don't", "İΣς 中文 a\u0301"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("abcdeXY' stremld0129.,!?éÀß²\n") for _ in range(rng.randrange(900))) for _ in range(120)]


def test_byte_bpe_equals_library(texts):
    coder = ByteBpe(RANKS, PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    assert [i.tolist() for i in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert all(coder.decode(i) == t.encode() for i, t in zip(coder.encode(texts), texts))


def test_byte_bpe_on_spark(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (1, texts[1])], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens")
    got = {r.doc_id: r for r in decode(encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()}
    assert all(bytes(got[i].decoded) == t.encode() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))
    assert got[900].n_tokens == 0 and decode(encode(docs.limit(0), RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_word_ids_equal_library(texts, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    for remembered in (400_000, 20):
        monkeypatch.setattr(word_tokens, "REMEMBERED", remembered)
        ids, at = word_tokens.WordEncoder(WORDS).encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


SPELLED = ["a <|endoftext|> b", "x<|endoftext|>y", "<|ENDOFTEXT|> <|endoftext|><|startoftext|>", "é<|startoftext|>e\u0301 中<|endoftext|>", "<| endoftext|>", "\x1c<|endoftext|>\x85I'LL"]


def test_special_tokens_as_by_an_unchanged_library(spark, texts, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    rows = texts + SPELLED
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert want[len(texts)] == [320, 49407, 321]
    for remembered in (400_000, 20):
        monkeypatch.setattr(word_tokens, "REMEMBERED", remembered)
        ids, at = word_tokens.WordEncoder(WORDS, special=True).encode(rows)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_queries_read_special_tokens_as_the_library(spark, texts):
    import corpus_pipeline
    from studyspark.llm.queries import op5_fit_packing, op10_cut_packing
    rows = texts[:20] + SPELLED
    folder = scratch_path(spark, "input")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs.write.parquet(f"{folder}/documents.parquet")
    library = Tokenizer.from_file(WORDS)
    want = {i: np.array(library.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in enumerate(rows)}
    pieces_of = {r.doc_id: bytes(r.ids) for r in corpus_pipeline.pack(spark, docs, folder).where("length = doc_tokens").collect()}
    assert len(pieces_of) > 20 and all(ids == want[i] for i, ids in pieces_of.items())
    for query in (op5_fit_packing, op10_cut_packing):
        for r in query(spark, folder).collect():
            assert r.doc_tokens * 4 == len(want[r.doc_id])
            assert r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start * 4:(r.start + r.length) * 4])


def test_best_fit():
    rng = random.Random(2)
    for most in (1, 7, 64):
        sizes = [rng.randrange(1, most + 1) for _ in range(300)]
        packed = best_fit(sizes, most)
        assert sorted(i for w in packed for i in w) == list(range(300)) and all(sum(sizes[i] for i in w) <= most for w in packed)
        # The plain form of the same rule: longest first, into the fullest window with room.
        room = []
        for size in sorted(sizes, reverse=True):
            fits = [r for r in room if r >= size]
            if fits:
                room.remove(min(fits))
            room.append((min(fits) if fits else most) - size)
        assert sorted(room) == sorted(most - sum(sizes[i] for i in w) for w in packed)


def check_pieces(rows, texts, window):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    want = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    docs, sequences = {}, {}
    for r in rows:
        assert bytes(r.ids) == want[r.doc_id][r.start:r.start + r.length].tobytes() and r.doc_tokens == len(want[r.doc_id]) and r.length > 0
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert docs.keys() == want.keys()
    for parts, size in [(docs[k], len(want[k])) for k in want] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= window if size is None else at == size
    return sum(map(len, want.values())), len(sequences)


def test_packing(spark, texts):
    rows = dict(enumerate(texts)) | {900: None}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5).selectExpr("*", "1 AS ids", "2 AS part", "3 AS at")
    tokens = written(word_tokens.tokenize(docs, WORDS), "tokens")
    total, sequences = check_pieces(cut(tokens, window=64).collect(), rows, 64)
    assert sequences == -(-total // 64)
    joined = windows(cut(tokens, window=64)).collect()
    assert sum(len(w.ids) for w in joined) == 4 * total and all(sum(b.length for b in w.boundaries) * 4 == len(w.ids) for w in joined)
    packed = written(pack(docs, WORDS, window=64, block_tokens=2000), "packed")
    total, sequences = check_pieces(pieces(packed).collect(), rows, 64)
    assert sequences <= 1.1 * total / 64 + 5
    for r in packed.collect():
        bounds, positions = r.cu_seqlens, np.frombuffer(r.position_ids, "<u2")
        assert len(r.ids) == 256 and r.n_tokens == bounds[-1] and bounds[0] == 0
        assert positions.tolist() == [i - max(b for b in bounds if b <= i) if i < r.n_tokens else 0 for i in range(64)]
    assert cut(written(word_tokens.tokenize(docs.limit(0), WORDS), "tokens")).count() == 0 == pieces(pack(docs.limit(0), WORDS)).count()
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert cut(written(word_tokens.tokenize(twice, WORDS), "tokens")).count() == pieces(written(pack(twice, WORDS), "packed")).count() == 3


PAGES = [(1, None, None), (2, "http://a b/é\n", "x"), (3, "u", "x"), (None, "u", "x"), (5, None, ""), (6, "u", "z" * 400_000), (7, "u", "é\r\n\r\nWARC/1.1"), (7, "u", "é\r\n\r\nWARC/1.1")]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest", "3 AS id")
    folder = scratch_path(spark, "warc")
    write_archives(with_revisits(pages), folder, archive_bytes=500)
    got = {(r.record, r.payload_digest, r.record_type): r for r in read_archives(spark, folder).collect()}
    first = {}
    for key, _, html in PAGES:
        first[html or ""] = min(k for k, _, h in PAGES if (h or "") == (html or "") and k is not None)
    for key, _, html in PAGES:
        data = (html or "").encode()
        kind = "response" if first[html or ""] == key else "revisit"
        r = got[None if key is None else str(key), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind]
        assert r.payload_bytes == len(data) and r.sound and r.refers_to == (None if kind == "response" else str(first[html or ""]))
        assert r.payload is None if kind == "revisit" else bytes(r.payload) == data
    files = spark.read.format("binaryFile").load(folder).collect()
    assert len(files) > 1 and all(gzip.decompress(f.content).startswith(b"WARC/1.1\r\n") for f in files)


def test_empty_archive_folder(spark):
    folder = scratch_path(spark, "warc")
    write_archives(with_revisits(spark.createDataFrame([], "page_id long, url string, html string")), folder)
    assert read_archives(spark, folder).count() == 0


def test_bad_archives():
    good = record(1, "u", b"abc", None, "2024-01-01T00:00:00Z")
    assert [b.endswith(b"abc") for _, b in read_records(good + b"\0" + good + b"\0")] == [True, True]
    with pytest.raises(ValueError):
        list(read_records(good[:-20]))
    plain = zlib.decompress(good, 31)
    for wrong in (plain.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1), plain + b"more", b"no header"):
        with pytest.raises(ValueError):
            list(read_records(gzip.compress(wrong)))


def test_pipeline_on_odd_documents(spark):
    import corpus_pipeline
    rng = random.Random(9)
    words = ["".join(rng.choice("aeilnorst") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30, 200))), "en", "s", 1) for i in range(300)]
    rows += [(400, rows[0][1], "en", "s", 1), (401, rows[1][1] + " more", None, None, None), (402, rows[2][1] + " mail me@x.org now", "en", "s", 1), (403, None, "en", "s", 1), (404, "short", "en", "s", 1)]
    rows += [(3, rows[3][1], "en", "s", 1), (None, rows[4][1] + " other words at the end of it", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS key", "1 AS _masked0")
    state = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        state = written(stage(spark, state, ""), "stage")
        assert state.columns == docs.columns
        counts.append(state.count())
    left = {r.doc_id: r for r in state.collect()}
    assert counts == [len(rows) - 2, len(rows) - 2 - 4, len(rows) - 2 - 4]      # 400, 401, 402 and one row of 3 go
    assert not {400, 401, 402, 403, 404} & left.keys() and set(range(300)) <= left.keys() and None in left
    mail = spark.createDataFrame([(1, "mail me@x.org now", "en", "s", 17), (1, "me@x.org", "en", "s", 8), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text or "", r.n_chars or 0) for r in corpus_pipeline.mask_personal_data(spark, mail, "").collect()) == [(1, "<email>", 7), (1, "mail <email> now", 16), (2, "", 0)]
    packed = corpus_pipeline.pack(spark, state, "").collect()
    assert {r.doc_id for r in packed} == set(left)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
