"""Corpus preparation: cleaning, splitting, chunking and chunk metadata.

Everything but topic propagation is narrow: a document's paragraphs, sentences and chunks are
built inside its own row and exploded with their position, so no shuffle is needed to number them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyspark.functions import text as t


def clean_text(df: DataFrame, preserve_markdown: bool = True, preserve_formulas: bool = True, column: str = "text") -> DataFrame:
    return df.withColumn(column, t.clean_text(F.col(column), preserve_markdown, preserve_formulas))


def strip_markdown(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, t.strip_markdown(F.col(column)))


def clean_pdf(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, t.clean_pdf(F.col(column)))


def normalize_formats(df: DataFrame) -> DataFrame:
    """Clean each document by its ``fmt`` column."""
    by_format = (
        F.when(F.col("fmt") == "markdown", t.strip_markdown(F.col("text")))
        .when(F.col("fmt") == "pdf", t.clean_pdf(F.col("text")))
        .otherwise(F.col("text"))
    )
    return df.withColumn("text", t.clean_text(by_format))


def paragraphs(df: DataFrame, sep: str = "\n\n") -> DataFrame:
    """One row per non-empty paragraph, numbered in order; the other columns stay."""
    rest = [c for c in df.columns if c != "text"]
    return df.select(*rest, F.posexplode(t.paragraphs(F.col("text"), sep)).alias("para_no", "text"))


def sentences(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "text"]
    return df.select(*rest, F.posexplode(t.sentences(F.col("text"))).alias("sent_no", "text"))


def chunk(df: DataFrame, max_size: int = 500, preserve_structure: bool = True, sep: str = "\n\n") -> DataFrame:
    rest = [c for c in df.columns if c != "text"]
    pieces = t.chunk_array(F.col("text"), max_size, preserve_structure, sep)
    return df.select(*rest, F.posexplode(pieces).alias("chunk_no", "text"))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Type, formula flag, counts, level and own topic of every chunk."""
    return (
        chunks.withColumn("text", t.strip(F.col("text")))
        .withColumn("has_formula", t.has_formula(F.col("text")))
        .withColumn("type", t.content_type(F.col("text"), F.col("has_formula")))
        .withColumn("char_count", F.length("text").cast("bigint"))
        .withColumn("word_count", t.word_count(F.col("text")))
        .withColumn("academic_level", t.academic_level(F.col("text"), F.col("has_formula"), F.col("word_count")))
        .withColumn("own_topic", t.own_topic(F.col("text")))
    )


def propagate_topic(chunks: DataFrame, doc: str = "doc_id", pos: str = "chunk_no") -> DataFrame:
    """Topic of every chunk: its own, else that of the last heading or formula before it, else the
    start of its first line. The first such chunk without an own topic lends its fallback."""
    before = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    lends = F.col("type").isin("heading", "formula")
    fallback = t.fallback_topic(F.col("text"))
    carried = F.coalesce(
        F.last(F.when(lends, F.col("own_topic")), ignorenulls=True).over(before),
        F.first(F.when(lends, fallback), ignorenulls=True).over(before),
    )
    return chunks.withColumn("topic", F.coalesce(F.col("own_topic"), carried, fallback))


def corpus_profile(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunk count, mean size and formula chunks per group and content type."""
    return chunks.groupBy(*by, "type").agg(
        F.count("*").alias("chunks"),
        F.avg("char_count").alias("avg_chars"),
        F.sum("word_count").alias("words"),
        F.count_if("has_formula").alias("formula_chunks"),
        F.count_if(F.col("academic_level") == "advanced").alias("advanced_chunks"),
    )
