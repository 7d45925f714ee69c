"""Structure of recognised text: lines, sections and blocks of a document.

Lines are classified inside the document row. Sections and blocks need running sums per document:
one shuffle by document serves all the windows and the grouping that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.functions import text as t

SHORT_PARAGRAPH = 60
HEADING_MAX_CHARS = 120


def normalize_ws(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, t.normalize_ws(F.col(column)))


def _is_fence(line: Column) -> Column:
    return F.startswith(F.ltrim(line), F.lit("```"))


def _heading(s: Column) -> Column:
    words = t.word_count(s)
    capitalised = F.regexp_count(s, F.lit(rf"(^|[{fx.SPACE_CLASS}])\p{{Lu}}"))
    title_case = capitalised >= F.greatest(F.lit(1), F.floor(words * 0.6))
    return (F.length(s) <= HEADING_MAX_CHARS) & (
        ((words <= 10) & (t.is_upper(s) | title_case))
        | (F.endswith(s, F.lit(":")) & (words <= 12))
        | F.rlike(s, F.lit(fx.RULED_HEADING))
    )


def _clean_line(line: Column) -> Column:
    return t.replace_all(t.replace_all(t.strip(line), fx.LIST_MARKER), f"[{fx.SPACE_CLASS}]+", " ")


def _math_parts(line: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(line, F.lit(p), F.lit(0)) for p in fx.MATH_PATTERNS])


def _inside_code(lines: Column, text: Column) -> Column:
    """For every line, whether an odd number of fences comes before it. Only documents that hold a
    fence pay for the scan."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<boolean>").alias("out"))
    scanned = F.aggregate(
        lines, start,
        lambda s, line: F.struct(
            F.when(_is_fence(line), ~s["inside"]).otherwise(s["inside"]).alias("inside"),
            F.concat(s["out"], F.array(s["inside"])).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.when(F.contains(text, F.lit("```")), scanned)


def classify_lines(df: DataFrame) -> DataFrame:
    """doc_id, line_no, kind, line, clean: the first kind that applies, in reading order of the rules."""
    rest = [c for c in df.columns if c != "text"]
    norm = df.withColumn("text", t.normalize_ws(F.col("text"))).withColumn("_lines", F.split("text", t.NL))
    flagged = norm.select(
        *rest,
        F.posexplode(F.arrays_zip(
            F.col("_lines").alias("line"),
            F.coalesce(_inside_code(F.col("_lines"), F.col("text")), F.array().cast("array<boolean>")).alias("inside"),
        )).alias("line_no", "_l"),
    ).select(*rest, "line_no", F.col("_l.line").alias("line"), F.coalesce("_l.inside", F.lit(False)).alias("_inside"))
    s = t.strip(F.col("line"))
    bars = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    kind = (
        F.when(s == "", "blank")
        .when(_is_fence(F.col("line")), F.when(F.col("_inside"), "fence_close").otherwise("fence_open"))
        .when(F.col("_inside"), "code")
        .when(_heading(s), "heading")
        .when((bars >= 2) | F.rlike(s, F.lit(fx.TABLE_DIVIDER)), "table")
        .when(F.rlike(s, F.lit(fx.LIST_MARKER)), "list")
        .when(F.rlike(F.col("line"), F.lit("|".join(fx.MATH_PATTERNS))), "math")
        .otherwise("paragraph")
    )
    return flagged.withColumn("kind", kind).withColumn("clean", _clean_line(F.col("line"))).drop("_inside")


def with_sections(lines: DataFrame) -> DataFrame:
    """Number the section of every line: 1 before the first heading, one more at each heading."""
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section_no", (F.sum((F.col("kind") == "heading").cast("int")).over(upto) + 1).cast("int"))


def sections(lines: DataFrame) -> DataFrame:
    """doc_id, section_no, title, lines. An empty leading section is dropped."""
    body = ~F.col("kind").isin("heading", "blank", "fence_close")
    return (
        with_sections(lines)
        .groupBy("doc_id", "section_no")
        .agg(
            F.max(F.when(F.col("kind") == "heading", F.regexp_replace("clean", ":+$", ""))).alias("title"),
            F.count_if(body).alias("lines"),
        )
        .filter(F.col("title").isNotNull() | (F.col("lines") > 0))
    )


def _elements(lines: DataFrame) -> DataFrame:
    """Block elements in order. A math line gives one element per span and its remaining text."""
    rest_text = _clean_line(t.replace_all(F.col("line"), fx.MATH_MARKUP))
    spans = F.transform(_math_parts(F.col("line")), lambda m: F.struct(F.lit("math").alias("type"), m.alias("text")))
    remainder = F.filter(F.array(F.struct(F.lit("paragraph").alias("type"), rest_text.alias("text"))), lambda x: x["text"] != "")
    single = F.array(F.struct(
        F.when(F.col("kind").isin("fence_open", "code"), "code").otherwise(F.col("kind")).alias("type"),
        F.when(F.col("kind").isin("table", "code"), F.rtrim("line")).when(F.col("kind") == "fence_open", t.strip(F.col("line")))
        .otherwise(F.col("clean")).alias("text"),
    ))
    parts = F.when(F.col("kind") == "math", F.concat(spans, remainder)).otherwise(single)
    return (
        lines.filter(~F.col("kind").isin("blank", "heading", "fence_close"))
        .select("doc_id", "section_no", "line_no", "kind", F.posexplode(parts).alias("elem_no", "_e"))
        .select("doc_id", "section_no", "line_no", "kind", "elem_no", "_e.type", "_e.text")
    )


def blocks(lines: DataFrame) -> DataFrame:
    """doc_id, section_no, block_no, type, text, items: adjacent list, table and code lines form one
    block, and a short paragraph line continues the paragraph before it, also across blank lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no", "elem_no")
    previous = F.lag(F.struct("section_no", "type", "line_no")).over(order)
    same = (F.col("_p.section_no") == F.col("section_no")) & (F.col("_p.type") == F.col("type"))
    joins = (
        F.when(F.col("type") == "list", same)
        .when(F.col("type") == "table", same & (F.col("line_no") - F.col("_p.line_no") == 1))
        .when(F.col("kind") == "code", same)
        .when(F.col("type") == "paragraph", same & (F.length("text") < SHORT_PARAGRAPH))
        .otherwise(False)
    )
    numbered = (
        _elements(with_sections(lines))
        .withColumn("_p", previous)
        .withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int"))
        .withColumn("block_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    )
    grouped = numbered.groupBy("doc_id", "section_no", "block_no", "type").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line_no", "elem_no", "text"))), lambda x: x["text"]
        ).alias("items")
    )
    return grouped.withColumn(
        "text", F.when(F.col("type") == "paragraph", F.array_join("items", " ")).otherwise(F.array_join("items", t.NL))
    )


def math_spans(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, span_no, span, rest of every math line."""
    rest = _clean_line(t.replace_all(F.col("line"), fx.MATH_MARKUP))
    return lines.filter(F.col("kind") == "math").select(
        "doc_id", "line_no", F.posexplode(_math_parts(F.col("line"))).alias("span_no", "span"), rest.alias("rest")
    )


def flatten_blocks(blocks_df: DataFrame, sections_df: DataFrame) -> DataFrame:
    """The document back as text: section titles, paragraphs, ``- item`` lines and markdown."""
    body = F.when(
        F.col("type") == "list",
        F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x)), t.NL),
    ).otherwise(F.col("text"))
    parts = blocks_df.select("doc_id", "section_no", "block_no", body.alias("part")).unionByName(
        sections_df.filter(F.coalesce("title", F.lit("")) != "").select("doc_id", "section_no", F.lit(0).alias("block_no"), F.col("title").alias("part"))
    )
    return parts.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("section_no", "block_no", "part"))), lambda x: x["part"]), t.NL
        ).alias("text")
    )


BLOCK_TYPES = ("paragraph", "list", "table", "code", "math")


def document_profile(df: DataFrame, blocks_df: DataFrame, sections_df: DataFrame) -> DataFrame:
    """Per document: lines, words, sections, blocks by type and text confidence."""
    norm = t.normalize_ws(F.col("text"))
    base = df.select(
        "doc_id", F.size(F.split(norm, t.NL)).cast("bigint").alias("line_count"), t.term_count(norm).alias("word_count"),
        t.text_confidence(F.col("text")).alias("confidence"),
    )
    kinds = blocks_df.groupBy("doc_id").agg(
        *[F.count_if(F.col("type") == k).alias(f"{k}_blocks") for k in BLOCK_TYPES]
    )
    heads = sections_df.groupBy("doc_id").agg(F.count("*").alias("sections"))
    return base.join(heads, "doc_id", "left").join(kinds, "doc_id", "left").na.fill(0)
