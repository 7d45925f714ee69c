"""Results of text recognition: pages, lines and the choice between services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.functions.text import NL, strip, text_confidence
from studyspark.operators.paging import top_n


def with_confidence(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", text_confidence(F.col("text")))


def merge_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id, text, confidence, page_count: all pages in order, or the first ``limit``, with page marks between them."""
    if limit is None:
        first = pages.withColumn("page_num", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")))
    else:
        first = top_n(pages, ["doc_id"], [F.col("page_no")], limit, rank="page_num")
    marked = F.transform(
        F.array_sort(F.collect_list(F.struct("page_num", "text"))),
        lambda p: F.when(p["page_num"] == 1, p["text"]).otherwise(
            F.concat(F.lit("\n\n--- PAGE "), p["page_num"].cast("string"), F.lit(" ---\n\n"), p["text"])
        ),
    )
    return first.groupBy("doc_id").agg(
        F.array_join(marked, "").alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("page_count")
    )


def merge_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, text, confidence from the LINE blocks; a missing confidence counts as 100."""
    lines = blocks.filter(F.col("block_type") == "LINE").withColumn("text", strip(F.coalesce("text", F.lit(""))))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    merged = lines.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), NL).alias("text"),
        (F.avg(F.coalesce("confidence", F.lit(100.0))) / 100).alias("confidence"),
    )
    return (
        blocks.select("doc_id").distinct().join(merged, "doc_id", "left")
        .na.fill({"text": "", "confidence": 0.0})
    )


def select_ocr(candidates: DataFrame, services: tuple[str, str, str] = fx.OCR_SERVICES,
               second_below: float = 0.75, third_below: float = 0.7) -> DataFrame:
    """note_id, text, confidence, service, chain from rows (note_id, service, text, confidence, error).

    The second service runs only where the first failed or scored below ``second_below``, the third only
    where the best so far is below ``third_below``; a later result wins only if strictly better."""
    first, second, third = services

    def pick(service: str) -> Column:
        row = F.struct(
            F.col("error").isNull().alias("ok"), F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        )
        return F.max(F.when(F.col("service") == service, row))

    wide = candidates.groupBy("note_id").agg(pick(first).alias("a"), pick(second).alias("b"), pick(third).alias("c"))

    def best(text: Column, confidence: Column, service: Column) -> Column:
        return F.struct(text.alias("text"), confidence.alias("confidence"), service.alias("service"))

    def later(current: Column, tried: Column, row: Column, name: str) -> Column:
        better = tried & row["ok"] & (row["confidence"] > current["confidence"])
        return F.when(better, best(row["text"], row["confidence"], F.lit(name))).otherwise(current)

    def step(tried: Column, row: Column, name: str, absent: str | None) -> Column:
        missing = F.lit(absent) if absent else F.lit(None).cast("string")
        label = F.when(row.isNull(), missing).when(row["ok"], F.lit(name)).otherwise(F.lit(f"{name}_failed"))
        return F.when(tried, label)

    nothing = best(F.lit(""), F.lit(0.0), F.lit(None).cast("string"))
    always = F.lit(True)
    out = wide.withColumn("s1", F.when(F.col("a.ok"), best(F.col("a.text"), F.col("a.confidence"), F.lit(first))).otherwise(nothing))
    out = out.withColumn("t2", F.col("s1.service").isNull() | (F.col("s1.confidence") < second_below))
    out = out.withColumn("s2", later(F.col("s1"), F.col("t2"), F.col("b"), second))
    out = out.withColumn("t3", F.col("s2.confidence") < third_below)
    out = out.withColumn("s3", later(F.col("s2"), F.col("t3"), F.col("c"), third))
    chain = F.array_compact(F.array(
        step(always, F.col("a"), first, None), step(F.col("t2"), F.col("b"), second, None),
        step(F.col("t3"), F.col("c"), third, f"{third}_unavailable"),
    ))
    return out.select("note_id", "s3.text", "s3.confidence", "s3.service", chain.alias("chain"))


def ocr_chain_stats(results: DataFrame) -> DataFrame:
    """How often each fallback chain and final service occurs, with the mean confidence."""
    return results.groupBy(F.array_join("chain", ">").alias("chain"), F.coalesce("service", F.lit("none")).alias("service")).agg(
        F.count("*").alias("notes"), F.avg("confidence").alias("avg_confidence")
    )
