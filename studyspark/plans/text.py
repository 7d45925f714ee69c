"""Corpus preparation, layout and recognition queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.functions import text as t
from studyspark.operators import layout, ocr, text_prep
from studyspark.plans import views as v
from studyspark.plans.registry import Catalog
from studyspark.plans.views import SQL, with_views
from studyspark.session import spread
from studyspark.sources.tables import read_table

catalog = Catalog()


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)}, 'g')"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {q(fx.SPACES)})"


NL = "chr(10)"
RSTRIP = r"[\t\x0b-\r\x1c-\x20\x85\p{Z}]+(\n|\z)"
WORDS = f"[^{fx.SPACE_CLASS}]+"


def count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


def sql_clean(expr: str, markdown: bool = True, formulas: bool = True) -> str:
    expr = f"replace({expr}, chr(13) || chr(10), chr(10))"
    for a, b in fx.ENTITIES:
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    expr = sub(expr, r"[\x00-\x08\x0b-\x1f]")
    expr = sub(expr, RSTRIP, r"\1")
    expr = sub(expr, r"[ \t]+", " ")
    expr = f"regexp_replace({expr}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    expr = sub(expr, RSTRIP, r"\1")
    if not markdown:
        expr = sub(expr, r"(?m)^#+[\t-\r ]*")
        expr = sub(expr, r"(?m)^[\t-\r ]*[-*•][\t-\r ]*")
    if not formulas:
        expr = sub(sub(sub(expr, r"[=+×÷→⇒/]"), r"[₀-₉₊₋₌⁰-⁹⁺⁻⁼]"), r"\$[^\$]*\$")
    return expr


def sql_confidence(expr: str) -> str:
    n = f"CAST(length({expr}) AS DOUBLE)"
    return f"""CASE WHEN {expr} IS NULL OR length({sql_strip(expr)}) < 5 THEN CAST(0.3 AS DOUBLE) ELSE
      greatest(CAST(0.3 AS DOUBLE), least(CAST(1.0 AS DOUBLE), CAST(0.9 AS DOUBLE)
      - CASE WHEN (length({expr}) - length({sub(expr, r"[{}]".format(chr(92) + "p{L}" + chr(92) + "p{N}"))})) / {n} < 0.5 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      - CASE WHEN (length({expr}) - length({sub(expr, "[" + fx.SPACE_CLASS + "]")})) / {n} > 0.4 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      + CASE WHEN length({expr}) BETWEEN 50 AND 5000 THEN CAST(0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) END"""


SQL["lines"] = f"""
  SELECT doc_id, lang, source, i AS line_no, arr[i + 1] AS line
  FROM (SELECT doc_id, lang, source, string_split(text, {NL}) AS arr FROM documents), unnest(range(len(arr))) AS u(i)"""

SQL["chunk_text"] = f"""
  SELECT doc_id, lang, source, line_no AS chunk_no, {sql_strip("line")} AS text FROM lines WHERE {sql_strip("line")} <> ''"""

FIRST_SENTENCE = r"(?s)^(.*?[.!?])[\t-\r ]"
TERMS = " + ".join(f"CAST(contains(lower(text), {q(w)}) AS INTEGER)" for w in fx.TECHNICAL_TERMS)

SQL["chunk_meta"] = f"""
  SELECT *, CASE WHEN {has("text", FIRST_SENTENCE)} THEN regexp_extract(text, {q(FIRST_SENTENCE)}, 1) ELSE text END AS first_sentence,
    {has("text", fx.FORMULA_MARK)} AS has_formula, length(text) AS char_count, {count("text", WORDS)} AS word_count,
    CASE WHEN starts_with(text, '#') OR (length(text) < 50 AND NOT {has("text", r"[.!?:;]$")} AND {has("text", r"^\p{Lu}")}
              AND length(text) - length(replace(text, ' ', '')) < 10) THEN 'heading'
         WHEN {has("text", fx.FORMULA_MARK)} THEN 'formula'
         WHEN {has("text", fx.LIST_START)} THEN 'list' ELSE 'paragraph' END AS type
  FROM chunk_text"""

SQL["chunk_own"] = f"""
  SELECT *, left(text, 80) AS fallback,
    CASE WHEN starts_with(text, '#') THEN {sql_strip(sub("text", "^#+[" + chr(92) + "t-" + chr(92) + "r ]*"))}
         WHEN length(text) < 100 AND {has("text", r"^\p{Lu}")} AND NOT {has("text", r"[.!?]$")} THEN text
         WHEN length({sql_strip("first_sentence")}) < 100 THEN {sql_strip("first_sentence")} END AS own_topic,
    CASE WHEN has_formula THEN 2 ELSE 0 END + CAST(word_count > 50 AS INTEGER) + CAST(word_count > 100 AS INTEGER)
      + {TERMS} + CAST({has("text", "[:;]")} AS INTEGER) AS score
  FROM chunk_meta"""

SQL["chunks"] = """
  SELECT doc_id, lang, source, chunk_no, text, type, has_formula, char_count, word_count,
    CASE WHEN score >= 4 THEN 'advanced' WHEN score >= 2 THEN 'intermediate' ELSE 'basic' END AS academic_level, own_topic,
    coalesce(own_topic,
      last_value(CASE WHEN type IN ('heading', 'formula') THEN own_topic END IGNORE NULLS) OVER w,
      first_value(CASE WHEN type IN ('heading', 'formula') THEN fallback END IGNORE NULLS) OVER w, fallback) AS topic
  FROM chunk_own WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

CHUNKS = "lines chunk_text chunk_meta chunk_own chunks"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "doc_id")


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-blank line is a chunk; its number is its line number."""
    return (
        documents(spark, sf)
        .select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("chunk_no", "text"))
        .withColumn("text", t.strip(F.col("text")))
        .filter(F.col("text") != "")
    )


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return text_prep.propagate_topic(text_prep.chunk_metadata(chunk_rows(spark, sf)))


@catalog.add("b1_clean_text", f"""
SELECT 'document' AS kind, doc_id AS id, {sql_clean("text")} AS text FROM documents
UNION ALL SELECT 'page', page_id, {sql_clean("html")} FROM pages""")
def _(spark, sf):
    pages = read_table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = documents(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return text_prep.clean_text(docs.unionByName(pages))


@catalog.add("b2_clean_without_marks", f"""
SELECT 'document' AS kind, doc_id AS id, {sql_clean("text", False, False)} AS text FROM documents
UNION ALL SELECT 'page', page_id, {sql_clean("html", False, False)} FROM pages""")
def _(spark, sf):
    pages = read_table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = documents(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return text_prep.clean_text(docs.unionByName(pages), preserve_markdown=False, preserve_formulas=False)


@catalog.add("b3_strip_markdown")
def _(spark, sf):
    return text_prep.strip_markdown(documents(spark, sf)).select("doc_id", "text")


@catalog.add("b4_clean_pdf", f"""
WITH a AS (SELECT doc_id, {sub(sub(r"regexp_replace(text, '([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)', '\1\2', 'g')",
                                   r"(?m)^[\t-\r ]*[0-9]+[\t-\r ]*$"), r"(?i)Page[\t-\r ]+[0-9]+")} AS text FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, {NL}), lambda x: {sql_strip("x")}),
  lambda x: length(x) > 3 AND NOT (length(x) < 20 AND {has("x", r"\p{Lu}")} AND NOT {has("x", r"\p{Ll}")})), {NL}) AS text FROM a""")
def _(spark, sf):
    return text_prep.clean_pdf(documents(spark, sf)).select("doc_id", "text")


@catalog.add("b5_paragraphs", f"""
WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(text, {NL}), lambda x: {sql_strip("x")}), lambda x: x <> '') AS p FROM documents)
SELECT doc_id, i AS para_no, p[i + 1] AS text FROM a, unnest(range(len(p))) AS u(i)""")
def _(spark, sf):
    return text_prep.paragraphs(documents(spark, sf), "\n").select("doc_id", F.col("para_no").cast("bigint").alias("para_no"), "text")


@catalog.add("b6_sentences", f"""
WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(text, {NL}), lambda x: {sql_strip("x")}), lambda x: x <> '') AS p FROM documents),
b AS (SELECT doc_id, i AS para_no, list_filter(list_transform(string_split(
        regexp_replace(p[i + 1], '([.!?])[\\t-\\r ]+', '\\1' || chr(10), 'g'), {NL}), lambda x: {sql_strip("x")}), lambda x: x <> '') AS s
      FROM a, unnest(range(len(p))) AS u(i))
SELECT doc_id, para_no, j AS sent_no, s[j + 1] AS text FROM b, unnest(range(len(s))) AS w(j)""")
def _(spark, sf):
    split = text_prep.sentences(text_prep.paragraphs(documents(spark, sf), "\n"))
    return split.select("doc_id", F.col("para_no").cast("bigint").alias("para_no"), F.col("sent_no").cast("bigint").alias("sent_no"), "text")


@catalog.add("b7_chunk")
def _(spark, sf):
    return text_prep.chunk(text_prep.clean_text(documents(spark, sf)), sep="\n").select("doc_id", "chunk_no", "text")


@catalog.add("b8_split_long_sentences")
def _(spark, sf):
    # Chunks this small force the comma and hard cuts.
    return text_prep.chunk(documents(spark, sf), max_size=60, sep="\n").select("doc_id", "chunk_no", "text")


@catalog.add("b9_free_flow_chunks")
def _(spark, sf):
    return text_prep.chunk(documents(spark, sf), preserve_structure=False, sep="\n").select("doc_id", "chunk_no", "text")


@catalog.add("b10_content_type", with_views("lines chunk_text chunk_meta", """
SELECT doc_id, chunk_no, type FROM chunk_meta"""))
def _(spark, sf):
    return chunk_rows(spark, sf).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), t.content_type(F.col("text")).alias("type")
    )


@catalog.add("b11_has_formula", with_views("lines chunk_text chunk_meta", """
SELECT doc_id, chunk_no, has_formula FROM chunk_meta"""))
def _(spark, sf):
    return chunk_rows(spark, sf).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), t.has_formula(F.col("text")).alias("has_formula")
    )


@catalog.add("b12_own_topic", with_views("lines chunk_text chunk_meta chunk_own", """
SELECT doc_id, chunk_no, coalesce(own_topic, '') AS own_topic FROM chunk_own"""))
def _(spark, sf):
    return chunk_rows(spark, sf).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.coalesce(t.own_topic(F.col("text")), F.lit("")).alias("own_topic")
    )


@catalog.add("b13_propagate_topic", with_views(CHUNKS, " SELECT doc_id, chunk_no, topic FROM chunks"))
def _(spark, sf):
    return chunks(spark, sf).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "topic")


@catalog.add("b14_text_counts", with_views("lines chunk_text chunk_meta", """
SELECT doc_id, chunk_no, char_count, word_count FROM chunk_meta"""))
def _(spark, sf):
    return chunk_rows(spark, sf).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("text").cast("bigint").alias("char_count"),
        t.word_count(F.col("text")).alias("word_count"),
    )


@catalog.add("b15_academic_level", with_views("lines chunk_text chunk_meta chunk_own", """
SELECT doc_id, chunk_no, CASE WHEN score >= 4 THEN 'advanced' WHEN score >= 2 THEN 'intermediate' ELSE 'basic' END AS academic_level FROM chunk_own"""))
def _(spark, sf):
    text = F.col("text")
    return chunk_rows(spark, sf).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
        t.academic_level(text, t.has_formula(text), t.word_count(text)).alias("academic_level"),
    )


@catalog.add("b16_corpus_profile", with_views("lines chunk_text chunk_meta chunk_own", """
SELECT lang, source, type, count(*) AS chunks, round(avg(char_count), 6) AS avg_chars, CAST(sum(word_count) AS BIGINT) AS words,
       count(*) FILTER (WHERE has_formula) AS formula_chunks, count(*) FILTER (WHERE score >= 4) AS advanced_chunks
FROM chunk_own GROUP BY ALL"""))
def corpus_profile(spark, sf):
    profile = text_prep.corpus_profile(text_prep.chunk_metadata(chunk_rows(spark, sf)), ["lang", "source"])
    return profile.withColumn("avg_chars", F.round("avg_chars", 6))


@catalog.add("b17_normalize_ws", "SELECT doc_id, " + sub(sub("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))", r"[\t\f\x0b]+", " "), RSTRIP, r"\1") + " AS text FROM documents")
def _(spark, sf):
    return layout.normalize_ws(documents(spark, sf)).select("doc_id", "text")


NORM = sub(sub("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))", r"[\t\f\x0b]+", " "), RSTRIP, r"\1")
MATH_ANY = "|".join(fx.MATH_PATTERNS)

SQL["norm_lines"] = f"""
  SELECT doc_id, i AS line_no, arr[i + 1] AS line, {sql_strip("arr[i + 1]")} AS s
  FROM (SELECT doc_id, string_split({NORM}, {NL}) AS arr FROM documents), unnest(range(len(arr))) AS u(i)"""
SQL["fenced"] = """
  SELECT *, starts_with(ltrim(line), '```') AS fence,
    coalesce(sum(CAST(starts_with(ltrim(line), '```') AS INTEGER)) OVER
      (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside
  FROM norm_lines"""
SQL["classified"] = f"""
  SELECT doc_id, line_no, line, {sub(sub("s", fx.LIST_MARKER), "[" + fx.SPACE_CLASS + "]+", " ")} AS clean,
    CASE WHEN s = '' THEN 'blank'
      WHEN fence THEN CASE WHEN inside THEN 'fence_close' ELSE 'fence_open' END
      WHEN inside THEN 'code'
      WHEN length(s) <= 120 AND (
        ({count("s", WORDS)} <= 10 AND (({has("s", r"\p{Lu}")} AND NOT {has("s", r"\p{Ll}")})
          OR {count("s", "(^|[" + fx.SPACE_CLASS + "])" + chr(92) + "p{Lu}")} >= greatest(1, floor({count("s", WORDS)} * 0.6))))
        OR (ends_with(s, ':') AND {count("s", WORDS)} <= 12) OR {has("s", fx.RULED_HEADING)}) THEN 'heading'
      WHEN length(s) - length(replace(s, '|', '')) >= 2 OR {has("s", fx.TABLE_DIVIDER)} THEN 'table'
      WHEN {has("s", fx.LIST_MARKER)} THEN 'list'
      WHEN {has("line", MATH_ANY)} THEN 'math' ELSE 'paragraph' END AS kind
  FROM fenced"""
SQL["sectioned"] = """
  SELECT *, 1 + sum(CAST(kind = 'heading' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM classified"""
SQL["sections"] = """
  SELECT * FROM (
    SELECT doc_id, section_no, max(CASE WHEN kind = 'heading' THEN regexp_replace(clean, ':+$', '') END) AS title,
           count(*) FILTER (WHERE kind NOT IN ('heading', 'blank', 'fence_close')) AS lines
    FROM sectioned GROUP BY ALL) WHERE title IS NOT NULL OR lines > 0"""
MATH_LIST = " || ".join(f"regexp_extract_all(line, {q(p)}, 0)" for p in fx.MATH_PATTERNS)
MATH_REST = sub(sub(sql_strip(sub("line", fx.MATH_MARKUP)), fx.LIST_MARKER), "[" + fx.SPACE_CLASS + "]+", " ")
SQL["elements"] = f"""
  SELECT doc_id, section_no, line_no, kind, 0 AS elem_no,
    CASE WHEN kind IN ('fence_open', 'code') THEN 'code' ELSE kind END AS type,
    CASE WHEN kind IN ('table', 'code') THEN rtrim(line) WHEN kind = 'fence_open' THEN {sql_strip("line")} ELSE clean END AS text
  FROM sectioned WHERE kind NOT IN ('blank', 'heading', 'fence_close', 'math')
  UNION ALL
  SELECT doc_id, section_no, line_no, kind, j, 'math', m[j + 1]
  FROM (SELECT *, {MATH_LIST} AS m FROM sectioned WHERE kind = 'math'), unnest(range(len(m))) AS u(j)
  UNION ALL
  SELECT doc_id, section_no, line_no, kind, 1000000, 'paragraph', {MATH_REST} FROM sectioned WHERE kind = 'math' AND {MATH_REST} <> ''"""
SQL["numbered"] = """
  SELECT *, sum(CASE WHEN section_no = ps AND type = pt AND (
        type = 'list' OR (type = 'table' AND line_no - pl = 1) OR kind = 'code' OR (type = 'paragraph' AND length(text) < 60)) THEN 0 ELSE 1 END)
      OVER (PARTITION BY doc_id ORDER BY line_no, elem_no) AS block_no
  FROM (SELECT *, lag(section_no) OVER w AS ps, lag(type) OVER w AS pt, lag(line_no) OVER w AS pl
        FROM elements WINDOW w AS (PARTITION BY doc_id ORDER BY line_no, elem_no))"""
SQL["blocks"] = f"""
  SELECT doc_id, section_no, block_no, type, count(*) AS items,
    CASE WHEN type = 'paragraph' THEN string_agg(text, ' ' ORDER BY line_no, elem_no) ELSE string_agg(text, {NL} ORDER BY line_no, elem_no) END AS text,
    string_agg('- ' || text, {NL} ORDER BY line_no, elem_no) AS bulleted
  FROM numbered GROUP BY doc_id, section_no, block_no, type"""
LINES = "norm_lines fenced classified"
SECTIONS = LINES + " sectioned sections"
BLOCKS = SECTIONS + " elements numbered blocks"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.classify_lines(documents(spark, sf).select("doc_id", "text"))


@catalog.add("b18_classify_lines", with_views(LINES, " SELECT doc_id, line_no, kind, clean FROM classified"))
def _(spark, sf):
    return lines(spark, sf).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "kind", "clean")


@catalog.add("b19_sections", with_views(SECTIONS, """
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, coalesce(title, '') AS title, lines FROM sections"""))
def _(spark, sf):
    return layout.sections(lines(spark, sf)).select(
        "doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.coalesce("title", F.lit("")).alias("title"), "lines"
    )


@catalog.add("b20_blocks", with_views(BLOCKS, """
SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, CAST(block_no AS BIGINT) AS block_no, type, items, text FROM blocks"""))
def _(spark, sf):
    return layout.blocks(lines(spark, sf)).select(
        "doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.col("block_no").cast("bigint").alias("block_no"),
        "type", F.size("items").cast("bigint").alias("items"), "text",
    )


@catalog.add("b21_math_spans", with_views(LINES, f"""
SELECT doc_id, line_no, j AS span_no, m[j + 1] AS span, {MATH_REST} AS rest
FROM (SELECT *, {MATH_LIST} AS m FROM classified WHERE kind = 'math'), unnest(range(len(m))) AS u(j)"""))
def _(spark, sf):
    return layout.math_spans(lines(spark, sf)).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("span_no").cast("bigint").alias("span_no"), "span", "rest"
    )


@catalog.add("b22_flatten_blocks", with_views(BLOCKS, f"""
SELECT doc_id, string_agg(part, {NL} ORDER BY section_no, block_no) AS text FROM (
  SELECT doc_id, section_no, block_no, CASE WHEN type = 'list' THEN bulleted ELSE text END AS part FROM blocks
  UNION ALL SELECT doc_id, section_no, 0, title FROM sections WHERE coalesce(title, '') <> '') GROUP BY doc_id"""))
def _(spark, sf):
    classified = lines(spark, sf)
    return layout.flatten_blocks(layout.blocks(classified), layout.sections(classified))


@catalog.add("b23_document_profile", with_views(BLOCKS, f"""
SELECT doc_id, len(string_split({NORM}, {NL})) AS line_count, len(regexp_extract_all({NORM}, '[\\p{{L}}\\p{{N}}_]+')) AS word_count,
  round({sql_confidence("text")}, 6) AS confidence, coalesce(s.n, 0) AS sections,
  coalesce(p, 0) AS paragraph_blocks, coalesce(l, 0) AS list_blocks, coalesce(tb, 0) AS table_blocks, coalesce(c, 0) AS code_blocks, coalesce(m, 0) AS math_blocks
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM sections GROUP BY 1) s USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE type = 'paragraph') AS p, count(*) FILTER (WHERE type = 'list') AS l,
  count(*) FILTER (WHERE type = 'table') AS tb, count(*) FILTER (WHERE type = 'code') AS c, count(*) FILTER (WHERE type = 'math') AS m
  FROM blocks GROUP BY 1) b USING (doc_id)"""))
def _(spark, sf):
    classified = lines(spark, sf)
    profile = layout.document_profile(documents(spark, sf), layout.blocks(classified), layout.sections(classified))
    return profile.withColumn("confidence", F.round("confidence", 6))


@catalog.add("b24_merge_pages", f"""
WITH p AS (SELECT conv_id, text, {sql_confidence("text")} AS confidence,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id AS doc_id, string_agg(CASE WHEN n = 1 THEN text ELSE chr(10) || chr(10) || '--- PAGE ' || CAST(n AS VARCHAR) || ' ---' || chr(10) || chr(10) || text END, '' ORDER BY n) AS text,
       round(avg(confidence), 6) AS confidence, count(*) AS page_count
FROM p GROUP BY conv_id""")
def _(spark, sf):
    pages = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return ocr.merge_pages(ocr.with_confidence(pages)).withColumn("confidence", F.round("confidence", 6))


@catalog.add("b25_text_confidence", f"SELECT doc_id, round({sql_confidence('text')}, 6) AS confidence FROM documents")
def _(spark, sf):
    return ocr.with_confidence(documents(spark, sf)).select("doc_id", F.round("confidence", 6).alias("confidence"))


@catalog.add("b26_merge_lines", with_views("lines", f"""
, b AS (SELECT doc_id, line_no, line, line_no % 5 <> 4 AS is_line,
          CASE WHEN line_no % 7 = 3 THEN NULL ELSE CAST(50 + length(line) % 50 AS DOUBLE) END AS confidence FROM lines)
SELECT doc_id, coalesce(string_agg({sql_strip("line")}, {NL} ORDER BY line_no) FILTER (WHERE is_line), '') AS text,
       round(coalesce(avg(coalesce(confidence, 100)) FILTER (WHERE is_line) / 100, 0), 6) AS confidence
FROM b GROUP BY doc_id"""))
def _(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    blocks = rows.withColumn("block_type", F.when(F.col("block_no") % 5 == 4, "WORD").otherwise("LINE")).withColumn(
        "confidence", F.when(F.col("block_no") % 7 != 3, (50 + F.length("text") % 50).cast("double"))
    )
    return ocr.merge_lines(blocks).withColumn("confidence", F.round("confidence", 6))


OCR_SQL = f"""
, d AS (SELECT doc_id, text, {sql_confidence("text")} AS c FROM documents),
k AS (SELECT doc_id, text,
    CASE doc_id % 5 WHEN 0 THEN 'failed' WHEN 4 THEN 'none' ELSE 'ok' END AS s1, c - CAST(doc_id % 4 AS DOUBLE) / 10 AS c1,
    CASE doc_id % 3 WHEN 0 THEN 'failed' ELSE 'ok' END AS s2, c - CAST(doc_id % 6 AS DOUBLE) / 10 AS c2,
    CASE doc_id % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'failed' ELSE 'ok' END AS s3, c - CAST(doc_id % 2 AS DOUBLE) / 10 AS c3 FROM d),
a AS (SELECT *, CASE WHEN s1 = 'ok' THEN c1 ELSE 0 END AS b1, CASE WHEN s1 = 'ok' THEN 'pixtral' END AS u1 FROM k),
b AS (SELECT *, u1 IS NULL OR b1 < 0.75 AS t2 FROM a),
e AS (SELECT *, CASE WHEN t2 AND s2 = 'ok' AND c2 > b1 THEN c2 ELSE b1 END AS b2, CASE WHEN t2 AND s2 = 'ok' AND c2 > b1 THEN 'trocr' ELSE u1 END AS u2 FROM b),
f AS (SELECT *, b2 < 0.7 AS t3 FROM e),
g AS (SELECT *, CASE WHEN t3 AND s3 = 'ok' AND c3 > b2 THEN c3 ELSE b2 END AS b3, CASE WHEN t3 AND s3 = 'ok' AND c3 > b2 THEN 'textract' ELSE u2 END AS u3 FROM f),
r AS (SELECT doc_id AS note_id, b3 AS confidence, coalesce(u3, 'none') AS service, concat_ws('>',
    CASE s1 WHEN 'ok' THEN 'pixtral' WHEN 'failed' THEN 'pixtral_failed' END,
    CASE WHEN t2 THEN CASE s2 WHEN 'ok' THEN 'trocr' WHEN 'failed' THEN 'trocr_failed' END END,
    CASE WHEN t3 THEN CASE s3 WHEN 'ok' THEN 'textract' WHEN 'failed' THEN 'textract_failed' ELSE 'textract_unavailable' END END) AS chain,
    CASE WHEN u3 IS NULL THEN '' ELSE u3 || text END AS text FROM g)"""


def ocr_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Three recognition attempts per document; some fail, some never ran."""
    base = ocr.with_confidence(documents(spark, sf)).select("doc_id", "text", "confidence")
    attempts = F.array(*[
        F.struct(F.lit(name).alias("service"), state.alias("state"), (F.col("confidence") - (F.col("doc_id") % m).cast("double") / 10).alias("confidence"))
        for name, state, m in zip(fx.OCR_SERVICES, (
            F.expr("CASE doc_id % 5 WHEN 0 THEN 'failed' WHEN 4 THEN 'none' ELSE 'ok' END"),
            F.expr("CASE doc_id % 3 WHEN 0 THEN 'failed' ELSE 'ok' END"),
            F.expr("CASE doc_id % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'failed' ELSE 'ok' END"),
        ), (4, 6, 2))
    ])
    return (
        base.select(F.col("doc_id").alias("note_id"), "text", F.explode(attempts).alias("a"))
        .filter("a.state <> 'none'")
        .select("note_id", "a.service", F.concat("a.service", "text").alias("text"), "a.confidence",
                F.when(F.col("a.state") == "failed", "error").alias("error"))
    )


@catalog.add("b27_select_ocr", "WITH x AS (SELECT 1)" + OCR_SQL + " SELECT note_id, round(confidence, 6) AS confidence, service, chain, text FROM r")
def _(spark, sf):
    return ocr.select_ocr(ocr_candidates(spark, sf)).select(
        "note_id", F.round("confidence", 6).alias("confidence"), F.coalesce("service", F.lit("none")).alias("service"),
        F.array_join("chain", ">").alias("chain"), "text",
    )


@catalog.add("i12_ocr_chain_stats", "WITH x AS (SELECT 1)" + OCR_SQL + """
SELECT chain, service, count(*) AS notes, round(avg(confidence), 6) AS avg_confidence FROM r GROUP BY ALL""")
def _(spark, sf):
    return ocr.ocr_chain_stats(ocr.select_ocr(ocr_candidates(spark, sf))).withColumn("avg_confidence", F.round("avg_confidence", 6))
