"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.plans.registry import Catalog
from studyspark.session import scratch_path, ship_package, written

catalog = Catalog()


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


@catalog.add("op9_url_filter")
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every url judged by the rules, else by a model fitted on urls that a rule decides."""
    from studyspark.llm.url_filter import fit_url_filter, rule_labels
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return fit_url_filter(rule_labels(pages)).apply(pages, "page_id")


def _word_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _with_crc(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@catalog.add("op5_fit_packing")
def op5_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Windows packed by best fit, written as matrices; one row per segment of the written windows."""
    from studyspark.llm.fit_packing import pack, pieces
    packed = written(pack(_table(spark, folder, "documents"), _word_vocabulary(), special=True), "packed")
    return _with_crc(pieces(packed))


@catalog.add("op10_cut_packing")
def op10_cut_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents end to end, cut into windows; one row per piece."""
    from studyspark.llm.cut_packing import cut
    from studyspark.llm.word_tokens import tokenize
    return _with_crc(cut(written(tokenize(_table(spark, folder, "documents"), _word_vocabulary(), special=True), "tokens")))


@catalog.add("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts encoded by merge ranks and decoded again."""
    import public_tokenizers
    from studyspark.llm.byte_bpe import decode, encode
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode(_table(spark, folder, "documents"), path, pattern)
    return decode(encoded, path, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@catalog.add("op6_warc")
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A WARC record per page, written and read back."""
    from studyspark.llm.warc import read_archives, with_revisits, write_archives
    target = scratch_path(spark, "warc")
    write_archives(with_revisits(_table(spark, folder, "pages")), target)
    read = read_archives(spark, target)
    return read.select(F.col("record").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"), "sound")


@catalog.add("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the outlier verdict of every document."""
    from studyspark.llm.quality import judged
    return judged(_table(spark, folder, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


@catalog.add("op2_pii")
def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Base and context-found spans of personal data in every document."""
    from studyspark.llm.pii import KINDS, find, joined_spans
    found = find(_table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined_spans("base").cast("binary"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


@catalog.add("op7_set_join")
def op7_set_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents grouped by the Jaccard similarity of their word 4-grams."""
    from studyspark.llm.set_join import near_duplicates
    return near_duplicates(_table(spark, folder, "documents"))


@catalog.add("op1_pq_dedup")
def op1_pq_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings grouped by cosine within their label."""
    from studyspark.llm.pq_dedup import near_duplicates
    return near_duplicates(_table(spark, folder, "embeddings"))


@catalog.add("op8_katz")
def op8_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Katz backoff and base scores of every document."""
    from studyspark.llm.katz import score
    return score(_table(spark, folder, "documents"))


@catalog.add("op11_turn_repair")
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations with the audit of their cheapest repair."""
    from studyspark.llm.turn_repair import damaged, repair, with_missing
    conversations = _table(spark, folder, "conversations")
    audits, _ = repair(damaged(conversations))
    return with_missing(audits, conversations)


@catalog.add("op12_swap_packing")
def op12_swap_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed into few windows by best fit and exchanges between windows; one row per piece."""
    from studyspark.llm.swap_packing import pack
    placed = pack(_table(spark, folder, "documents"), _word_vocabulary(), special=True)
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@catalog.add("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable embedding on its eight leading whitened components."""
    from studyspark.llm.whitening import whiten
    return whiten(_table(spark, folder, "embeddings"))


@catalog.add("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the training-data pipeline."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)
