"""Entity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.functions.mentions import CANDIDATE
from studyspark.operators import entities as e
from studyspark.plans.registry import Catalog
from studyspark.plans.text import CHUNKS, chunks, has, q, sql_strip, sub
from studyspark.plans.views import SQL, with_views

catalog = Catalog()


def sql_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


SQL["mention_arrays"] = f"""
  SELECT doc_id, chunk_no, topic AS context, list_filter(m, lambda x, i: list_position(lm, lower(x)) = i) AS m
  FROM (SELECT *, list_transform(m, lambda x: lower(x)) AS lm
        FROM (SELECT *, list_filter(regexp_extract_all(text, {q(CANDIDATE)}, 0),
          lambda x: {has("x", "^" + chr(92) + "p{Lu}|" + fx.TERM_FORMULA)} OR {sql_any("lower(x)", fx.ACADEMIC_KEYWORDS)}) AS m FROM chunks))"""
SQL["mentions"] = """
  SELECT doc_id, chunk_no, context, j AS pos, m[j + 1] AS text FROM mention_arrays, unnest(range(len(m))) AS u(j)"""
SQL["terms"] = f"""
  SELECT * FROM mentions
  WHERE lower(text) NOT IN ({", ".join(map(q, fx.STOP_WORDS))}) AND length(text) >= 3 AND NOT {has("text", "^[0-9]+$")}
    AND ({has("text", fx.TERM_FORMULA)} OR {sql_any("lower(text)", fx.ACADEMIC_KEYWORDS)} OR {has("text", r"^\p{Lu}")}
      OR (contains(text, ' ') AND length(text) > 5))"""
SQL["typed"] = f"""
  SELECT *, CASE WHEN {has("text", fx.TYPE_FORMULA)} OR {has("text", fx.CHEMICAL)} THEN 'Formula'
      WHEN {has("text", r"^\p{Lu}")} AND NOT contains(text, ' ') AND length(text) > 2 AND {sql_any("lower(context)", fx.ENTITY_CONTEXT)} THEN 'Entity'
      WHEN {has("text", r"^\p{Lu}[^ ]*(?: \p{Lu}[^ ]*){1,3}$")} THEN 'Topic' ELSE 'Concept' END AS type,
    CASE WHEN {has("text", fx.NORMAL_FORMULA)} THEN {sql_strip("text")}
      ELSE {sub(sql_strip("lower(text)"), "[.,;:!?]+$")} END AS norm
  FROM terms"""
MENTIONS = CHUNKS + " mention_arrays mentions"
TYPED = MENTIONS + " terms typed"
BIG = {"chunk_no": "cast(chunk_no AS bigint) AS chunk_no", "pos": "cast(pos AS bigint) AS pos"}


def entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    return e.entity_rows(chunks(spark, sf))


@catalog.add("c1_mentions", with_views(MENTIONS, " SELECT doc_id, chunk_no, pos, text FROM mentions"))
def _(spark, sf):
    return e.mentions(chunks(spark, sf)).select("doc_id", F.expr(BIG["chunk_no"]), F.expr(BIG["pos"]), "text")


@catalog.add("c2_filter_terms", with_views(MENTIONS + " terms", " SELECT doc_id, chunk_no, pos, text FROM terms"))
def _(spark, sf):
    return e.filter_terms(e.mentions(chunks(spark, sf))).select("doc_id", F.expr(BIG["chunk_no"]), F.expr(BIG["pos"]), "text")


@catalog.add("c3_classify_entity", with_views(TYPED, " SELECT doc_id, chunk_no, pos, type FROM typed"))
def _(spark, sf):
    return entity_rows(spark, sf).select("doc_id", F.expr(BIG["chunk_no"]), F.expr(BIG["pos"]), "type")


@catalog.add("c4_normalize_entity", with_views(TYPED, " SELECT doc_id, chunk_no, pos, norm FROM typed"))
def _(spark, sf):
    return entity_rows(spark, sf).select("doc_id", F.expr(BIG["chunk_no"]), F.expr(BIG["pos"]), "norm")


@catalog.add("c5_canonical", with_views(TYPED, """
, f AS (SELECT norm, text, count(*) AS n FROM typed GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, length(text) DESC, text) AS k, CAST(sum(n) OVER (PARTITION BY norm) AS BIGINT) AS mentions FROM f)
SELECT norm, text, mentions FROM r WHERE k = 1"""))
def _(spark, sf):
    return e.canonical(entity_rows(spark, sf)).select("norm", "text", "mentions")


@catalog.add("c7_entity_stats", with_views(TYPED, """
SELECT type, count(*) AS mentions, count(DISTINCT norm) AS unique_entities FROM typed GROUP BY type"""))
def _(spark, sf):
    return e.entity_stats(entity_rows(spark, sf))


@catalog.add("c8_attach_entities", with_views(TYPED, """
SELECT c.doc_id, c.chunk_no, count(t.text) AS n, coalesce(string_agg(t.type || ':' || t.text, '|' ORDER BY t.pos), '') AS entities
FROM chunks c LEFT JOIN typed t ON t.doc_id = c.doc_id AND t.chunk_no = c.chunk_no GROUP BY c.doc_id, c.chunk_no"""))
def _(spark, sf):
    named = F.transform("entities", lambda x: F.concat_ws(":", x["type"], x["text"]))
    return e.attach_entities(chunks(spark, sf)).select(
        "doc_id", F.expr(BIG["chunk_no"]), F.size("entities").cast("bigint").alias("n"), F.array_join(named, "|").alias("entities")
    )
