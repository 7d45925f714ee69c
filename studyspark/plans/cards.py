"""Card and quiz queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.functions.text import upper_each
from studyspark.operators import cards as c
from studyspark.operators import entities as e
from studyspark.plans import graph_build as pg
from studyspark.plans.entities import TYPED, entity_rows, sql_any
from studyspark.plans.registry import Catalog
from studyspark.plans.text import WORDS, count, has, q, sql_strip, sub
from studyspark.plans.views import SQL, with_views
from studyspark.schemas import QUIZ_CONTENT
from studyspark.session import cut_lineage
from studyspark.sources.tables import read_table

catalog = Catalog()
CHUNK_NO = "cast(chunk_no AS bigint) AS chunk_no"


def literal_list(kind: str, table, n: int | None = None) -> str:
    return "[" + ", ".join(q(x) for x in [t for k, t in table if k == kind][:n]) + "]"


H, P = fx.HEURISTIC_TEMPLATES, fx.PLAIN_TEMPLATES
NONE = "CAST([] AS VARCHAR[])"
SQL["chunk_cards"] = """
  SELECT c.*, coalesce(e, CAST([] AS VARCHAR[])) AS ents FROM chunks c
  LEFT JOIN (SELECT doc_id, chunk_no, list(text ORDER BY pos) AS e FROM typed GROUP BY ALL) x USING (doc_id, chunk_no)"""
SQL["h_templates"] = f"""
  SELECT *, list_slice(CASE WHEN len(t) > 0 THEN t ELSE {literal_list("definition", H, 2)} END, 1, 3) AS ts FROM (
    SELECT *, CASE WHEN has_formula THEN {literal_list("formula", H, 2)} ELSE {NONE} END
      || CASE WHEN len(ents) >= 2 THEN {literal_list("difference", H, 1)} ELSE {NONE} END
      || CASE WHEN academic_level = 'advanced' AND type = 'paragraph' THEN {literal_list("why_how", H, 1)} ELSE {NONE} END
      || CASE WHEN type IN ('paragraph', 'heading') THEN {literal_list("application", H, 1)} ELSE {NONE} END AS t FROM chunk_cards)"""
SQL["p_templates"] = f"""
  SELECT *, list_transform(list_slice(list_sort(list_transform(t,
      lambda x: md5(CAST(doc_id AS VARCHAR) || '|' || CAST(chunk_no AS VARCHAR) || '|' || x || '|42') || x)), 1, 3), lambda x: substr(x, 33)) AS ts FROM (
    SELECT *, {literal_list("definition", P)} || CASE WHEN has_formula THEN {literal_list("formula", P)} ELSE {NONE} END
      || CASE WHEN academic_level IN ('intermediate', 'advanced') THEN {literal_list("why_how", P)} ELSE {NONE} END
      || CASE WHEN len(ents) >= 2 THEN {literal_list("difference", P)} ELSE {NONE} END
      || CASE WHEN academic_level = 'advanced' THEN {literal_list("application", P)} ELSE {NONE} END AS t FROM chunk_cards)"""
STOP = ", ".join(q(w) for w in fx.QUESTION_STOP_WORDS)


def fills(expr: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        expr = f"replace({expr}, '{{{name}}}', {value})"
    return expr


NAMED = "coalesce(e1, topic)"
SQL["h_questions"] = f"""
  SELECT * FROM (SELECT doc_id, chunk_no, i AS q_no, text,
    CASE WHEN contains(ts[i + 1], '{{entity1}}') THEN {fills("ts[i + 1]", {"entity1": "e1", "entity2": "e2"})}
         WHEN contains(ts[i + 1], '{{entity}}') THEN {fills("ts[i + 1]", {"entity": "e1"})}
         ELSE {fills("ts[i + 1]", {"topic": "topic", "process": "topic", "phenomenon": "topic", "relationship": "topic", "concept": NAMED, "principle": NAMED, "method": NAMED})} END AS question
  FROM (SELECT *, es[1] AS e1, es[2] AS e2 FROM (SELECT *, list_filter(ents, lambda x: lower(x) NOT IN ({STOP}) AND length(x) > 2) AS es FROM h_templates)),
    unnest(range(len(ts))) AS u(i)) WHERE question IS NOT NULL AND NOT {has("question", "[{}]")}"""
SQL["p_questions"] = f"""
  SELECT * FROM (SELECT doc_id, chunk_no, i AS q_no, text,
    CASE WHEN contains(ts[i + 1], '{{entity1}}') THEN {fills("ts[i + 1]", {"entity1": "ents[1]", "entity2": "ents[2]"})}
         ELSE {fills("ts[i + 1]", {"entity": "coalesce(ents[1], topic)"})} END AS question
  FROM p_templates, unnest(range(len(ts))) AS u(i)) WHERE question IS NOT NULL AND NOT {has("question", "[{}]")}"""
VALID_Q = f"length(question) BETWEEN 5 AND 200 AND NOT {has('question', '[{}]')} AND length(question) - length(replace(question, '?', '')) = 1"
BASE = TYPED + " chunk_cards"


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return pg.chunks(spark, sf)


def _variants(make) -> DataFrame:
    parts = [make(v).withColumn("variant", F.lit(v)) for v in c.VARIANTS]
    return parts[0].unionByName(parts[1])


@catalog.add("g1_select_templates", with_views(BASE + " h_templates p_templates", """
SELECT 'heuristic' AS variant, doc_id, chunk_no, array_to_string(ts, '|') AS templates FROM h_templates
UNION ALL SELECT 'templates', doc_id, chunk_no, array_to_string(ts, '|') FROM p_templates"""))
def _(spark, sf):
    rows = chunk_rows(spark, sf)
    return _variants(lambda v: c.select_templates(rows, v).select("doc_id", F.expr(CHUNK_NO), F.array_join("templates", "|").alias("templates")))


@catalog.add("g2_fill_questions", with_views(BASE + " h_templates p_templates h_questions p_questions", """
SELECT 'heuristic' AS variant, doc_id, chunk_no, q_no, question FROM h_questions
UNION ALL SELECT 'templates', doc_id, chunk_no, q_no, question FROM p_questions"""))
def _(spark, sf):
    rows = chunk_rows(spark, sf)
    return _variants(lambda v: c.fill_questions(c.select_templates(rows, v), v).select("doc_id", F.expr(CHUNK_NO), F.col("q_no").cast("bigint").alias("q_no"), "question"))


@catalog.add("g3_valid_question", with_views(BASE + " p_templates p_questions", f"""
SELECT doc_id, chunk_no, q_no, question FROM p_questions WHERE {VALID_Q}"""))
def _(spark, sf):
    asked = c.fill_questions(c.select_templates(chunk_rows(spark, sf), "templates"), "templates")
    return c.valid_question(asked).select("doc_id", F.expr(CHUNK_NO), F.col("q_no").cast("bigint").alias("q_no"), "question")


SQL["overlap_input"] = """
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 0 AS q_no, question, answer AS text FROM (
    SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b
    ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
  UNION ALL SELECT CAST(doc_id AS VARCHAR) || '/' || CAST(chunk_no AS VARCHAR), q_no, question, text FROM p_questions"""
SQL["overlap"] = f"""
  SELECT id, q_no, s AS answer, least(CAST(0.7 AS DOUBLE), CAST(score AS DOUBLE) / len(kw)) AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY id, q_no ORDER BY score DESC, j) AS k FROM (
      SELECT id, q_no, kw, j, s, len(list_filter(kw, lambda k: contains(lower(s), k))) AS score FROM (
        SELECT id, q_no, kw, j, ss[j + 1] AS s FROM (
          SELECT id, q_no, list_filter(regexp_extract_all(lower(question), {q(WORDS)}), lambda w: length(w) > 3 AND w NOT IN ('what', 'does', 'how', 'why')) AS kw,
            list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: {sql_strip("x")}), lambda x: length(x) >= 20) AS ss FROM overlap_input),
          unnest(range(len(ss))) AS u(j)))
    WHERE score > 0) WHERE k = 1 AND length(s) BETWEEN 10 AND 500 AND NOT {has("s", "[{}]")}"""


@catalog.add("g4_answer_overlap", with_views(BASE + " p_templates p_questions overlap_input overlap", """
SELECT id, q_no, answer, round(confidence, 6) AS confidence FROM overlap"""))
def _(spark, sf):
    talk = pg.qa_cards(spark, sf).select(F.col("card_id").alias("id"), F.lit(0).alias("q_no"), "question", F.col("answer").alias("text"))
    asked = c.fill_questions(c.select_templates(chunk_rows(spark, sf), "templates"), "templates").select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("id"), "q_no", "question", "text"
    )
    return c.answer_overlap(talk.unionByName(asked)).select("id", F.col("q_no").cast("bigint").alias("q_no"), "answer", F.round("confidence", 6).alias("confidence"))


VALID_H = f"length(x) BETWEEN 10 AND 200 AND {has('x', '[a-zA-Z]')} AND NOT ({count('x', WORDS)} = 1 AND NOT {has('x', '[=+→]')})"
SQL["pattern"] = f"""
  SELECT doc_id, chunk_no, q_no, question, coalesce(a1, a2, a3, a4) AS answer,
    CASE WHEN coalesce(a1, a2) IS NOT NULL THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence FROM (
    SELECT *, CASE WHEN starts_with(lq, 'what is') THEN list_filter(ss, lambda x: contains(lower(x), subject) AND {VALID_H})[1] END AS a1,
      CASE WHEN {sql_any("lq", ("why", "how", "what causes"))} THEN list_filter(ss, lambda x: {sql_any("lower(x)", fx.CAUSAL_PHRASES)} AND {VALID_H})[1] END AS a2,
      CASE WHEN {sql_any("lq", ("formula", "equation"))} THEN list_filter([{sql_strip(f"regexp_extract(text, {q(fx.ANSWER_FORMULA)}, 0)")}], lambda x: {VALID_H})[1] END AS a3,
      list_filter([ss[1]], lambda x: {VALID_H})[1] AS a4 FROM (
      SELECT *, lower(question) AS lq, lower({sql_strip("replace(replace(replace(question, 'What is', ''), 'Define', ''), '?', '')")}) AS subject,
        list_transform(string_split(text, '.'), lambda x: {sql_strip("x")}) AS ss FROM h_questions)) WHERE coalesce(a1, a2, a3, a4) IS NOT NULL"""


@catalog.add("g5_answer_pattern", with_views(BASE + " h_templates h_questions pattern", """
SELECT doc_id, chunk_no, q_no, answer, confidence FROM pattern"""))
def _(spark, sf):
    asked = c.fill_questions(c.select_templates(chunk_rows(spark, sf)))
    return c.answer_pattern(asked).select("doc_id", F.expr(CHUNK_NO), F.col("q_no").cast("bigint").alias("q_no"), "answer", "confidence")


@catalog.add("g6_valid_answer", f"""
WITH a AS (SELECT conv_id, turn, text AS x FROM conversations)
SELECT conv_id, turn, {VALID_H} AS heuristic, length(x) BETWEEN 10 AND 500 AND NOT {has("x", "[{}]")} AS templates FROM a
WHERE ({VALID_H}) OR (length(x) BETWEEN 10 AND 500 AND NOT {has("x", "[{}]")})""")
def _(spark, sf):
    rows = read_table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("answer"))
    plain = c.valid_answer(rows, "templates").withColumn("templates", F.lit(True)).drop("answer")
    short = c.valid_answer(rows, "heuristic").withColumn("heuristic", F.lit(True)).drop("answer")
    return short.join(plain, ["conv_id", "turn"], "full_outer").na.fill(False)


def sql_difficulty(many: str) -> str:
    return f"least(5, CASE academic_level WHEN 'basic' THEN 1 WHEN 'intermediate' THEN 2 WHEN 'advanced' THEN 4 ELSE 2 END + CAST(has_formula AS INTEGER) + CAST(len(ents) {many} AS INTEGER))"


@catalog.add("g7_difficulty", with_views(BASE, f"""
SELECT doc_id, chunk_no, 'heuristic' AS variant, CAST({sql_difficulty(">= 5")} AS BIGINT) AS difficulty FROM chunk_cards
UNION ALL SELECT doc_id, chunk_no, 'templates', CAST({sql_difficulty("> 2")} AS BIGINT) FROM chunk_cards"""))
def _(spark, sf):
    rows = chunk_rows(spark, sf)
    return _variants(lambda v: c.difficulty(rows, v).select("doc_id", F.expr(CHUNK_NO), F.col("difficulty").cast("bigint").alias("difficulty")))


@catalog.add("g8_source_type", with_views(BASE + " p_templates p_questions overlap_input overlap", """
SELECT id, q_no, 'heuristic' AS variant, CASE WHEN confidence > 0.6 THEN 'qa_extracted' ELSE 'rule_based' END AS source_type FROM overlap
UNION ALL SELECT id, q_no, 'templates', CASE WHEN confidence > 0.75 THEN 'qa_extracted' ELSE 'rule_based' END FROM overlap"""))
def _(spark, sf):
    talk = pg.qa_cards(spark, sf).select(F.col("card_id").alias("id"), F.lit(0).alias("q_no"), "question", F.col("answer").alias("text"))
    asked = c.fill_questions(c.select_templates(chunk_rows(spark, sf), "templates"), "templates").select(
        F.concat_ws("/", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("id"), "q_no", "question", "text"
    )
    answered = cut_lineage(c.answer_overlap(talk.unionByName(asked)))
    return _variants(lambda v: c.source_type(answered, v).select("id", F.col("q_no").cast("bigint").alias("q_no"), "source_type"))


# The SQL distance counts bytes. The strings are lower case, so each accented letter is first replaced by
# a capital of its own and takes one byte.
ONE_BYTE = "translate({0}, 'éèêëçàâîïôûùäöüßñíóúá', 'ABCDEFGHIJKLMNOPQRSTU')"


def sql_leaders(items: str) -> str:
    """Views that take strings (s, ord) one by one in order: ``led`` has (s, leader). In every round the open strings without an
    earlier open neighbour lead and their neighbours follow; what never follows leads."""
    return f"""
it AS (SELECT s, {ONE_BYTE.format("s")} AS b, row_number() OVER (ORDER BY ord) AS n, length(s) AS l FROM {items}),
near AS (SELECT x.n AS a, y.n AS b FROM it x JOIN it y ON x.n < y.n AND abs(x.l - y.l) < 0.2 * greatest(x.l, y.l)
  AND 1.0 - CAST(levenshtein(x.b, y.b) AS DOUBLE) / greatest(x.l, y.l) > 0.8),
opened AS (SELECT 0 AS k, a, b FROM near UNION ALL (
  WITH first AS (SELECT a FROM opened EXCEPT SELECT b FROM opened), follow AS (SELECT DISTINCT b FROM opened WHERE a IN (SELECT a FROM first))
  SELECT k + 1, a, b FROM opened WHERE a NOT IN (SELECT b FROM follow) AND b NOT IN (SELECT b FROM follow))),
follows AS (SELECT DISTINCT o.b FROM opened o ANTI JOIN opened p ON p.k = o.k AND p.b = o.a),
led AS (SELECT y.s, x.s AS leader FROM (SELECT b, min(a) AS a FROM near WHERE a NOT IN (SELECT b FROM follows) AND b IN (SELECT b FROM follows) GROUP BY b) p
  JOIN it x ON x.n = p.a JOIN it y ON y.n = p.b UNION ALL SELECT s, s FROM it WHERE n NOT IN (SELECT b FROM follows))"""


SQL_QUESTION = sql_strip(sub(sub("lower(question)", "[?!.,;:]"), "[" + fx.SPACE_CLASS + "]+", " "))


def talk_cards(spark: SparkSession, sf: str) -> DataFrame:
    return pg.qa_cards(spark, sf).withColumn("ord", F.struct("conv_id", "turn"))


@catalog.add("g9_similar_questions", f"""
WITH k AS (SELECT DISTINCT {sql_strip(sub(sub("lower(a.text)", "[?!.,;:]"), "[" + fx.SPACE_CLASS + "]+", " "))} AS s
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT a.s AS sa, b.s AS sb FROM k a JOIN k b ON a.s < b.s AND abs(length(a.s) - length(b.s)) < 0.2 * greatest(length(a.s), length(b.s))
  AND 1.0 - CAST(levenshtein(a.s, b.s) AS DOUBLE) / greatest(length(a.s), length(b.s)) > 0.8""")
def _(spark, sf):
    return c.similar_questions(talk_cards(spark, sf))


@catalog.add("g9_dedup_cards", f"""
WITH RECURSIVE t AS (SELECT a.conv_id || '-' || a.turn AS card_id, a.conv_id, a.turn, a.text AS question, b.text AS answer
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
keyed AS (SELECT *, {SQL_QUESTION} AS s, row_number() OVER (ORDER BY conv_id, turn) AS ord FROM t),
items AS (SELECT s, min(ord) AS ord FROM keyed GROUP BY s),{sql_leaders("items")},
r AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY ord) AS f, row_number() OVER (PARTITION BY leader ORDER BY length(answer) DESC, ord) AS l FROM keyed JOIN led USING (s))
SELECT card_id, question, 'first' AS keep FROM r WHERE f = 1 UNION ALL SELECT card_id, question, 'longest' FROM r WHERE l = 1""")
def _(spark, sf):
    cards = talk_cards(spark, sf)
    groups = cut_lineage(c.question_groups(cards))
    first = c.dedup_cards(cards, "first", groups=groups).select("card_id", "question").withColumn("keep", F.lit("first"))
    return first.unionByName(c.dedup_cards(cards, "longest", groups=groups).select("card_id", "question").withColumn("keep", F.lit("longest")))


@catalog.add("g10_generate_cards", with_views(BASE + " h_templates h_questions pattern", f"""
SELECT p.doc_id, p.chunk_no, q_no, question, answer, topic AS context, CAST({sql_difficulty(">= 5")} AS BIGINT) AS difficulty,
       CASE WHEN confidence > 0.6 THEN 'qa_extracted' ELSE 'rule_based' END AS source_type
FROM pattern p JOIN chunk_cards c ON c.doc_id = p.doc_id AND c.chunk_no = p.chunk_no"""))
def _(spark, sf):
    return c.generate_cards(chunk_rows(spark, sf)).select(
        "doc_id", F.expr(CHUNK_NO), F.col("q_no").cast("bigint").alias("q_no"), "question", "answer", "context",
        F.col("difficulty").cast("bigint").alias("difficulty"), "source_type",
    )


@catalog.add("g10_generate_deck", with_views(BASE + " h_templates h_questions pattern", f""",
keyed AS (SELECT p.doc_id, p.chunk_no, q_no, question, answer, topic AS context, CAST({sql_difficulty(">= 5")} AS BIGINT) AS difficulty,
       CASE WHEN confidence > 0.6 THEN 'qa_extracted' ELSE 'rule_based' END AS source_type, confidence, {SQL_QUESTION} AS s,
       row_number() OVER (ORDER BY p.doc_id, p.chunk_no, q_no) AS ord
  FROM pattern p JOIN chunk_cards c ON c.doc_id = p.doc_id AND c.chunk_no = p.chunk_no),
items AS (SELECT s, min(ord) AS ord FROM keyed GROUP BY s),{sql_leaders("items")}
SELECT doc_id, chunk_no, q_no, question, answer, context, difficulty, source_type, confidence FROM keyed
WHERE ord IN (SELECT ord FROM items JOIN led ON led.s = items.s AND led.s = led.leader)""", recursive=True))
def _(spark, sf):
    cards = cut_lineage(c.generate_cards(chunk_rows(spark, sf)))
    return c.dedup_cards(cards, "first").drop("ord").withColumns({x: F.col(x).cast("bigint") for x in ("chunk_no", "q_no", "difficulty")})


@catalog.add("c6_similar_forms", with_views(TYPED, f"""
, f AS (SELECT norm, text, count(*) AS n FROM typed GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, length(text) DESC, text) AS k FROM f),
s AS (SELECT DISTINCT lower(text) AS s, {ONE_BYTE.format("lower(text)")} AS b FROM r WHERE k = 1)
SELECT a.s AS sa, b.s AS sb FROM s a JOIN s b ON a.s < b.s AND abs(length(a.s) - length(b.s)) < 0.2 * greatest(length(a.s), length(b.s))
  AND 1.0 - CAST(levenshtein(a.b, b.b) AS DOUBLE) / greatest(length(a.s), length(b.s)) > 0.8"""))
def _(spark, sf):
    return e.similar_forms(cut_lineage(e.canonical(entity_rows(spark, sf))))


@catalog.add("c6_fuzzy_merge", with_views(TYPED, f"""
, placed AS (SELECT norm, text, row_number() OVER (ORDER BY doc_id, chunk_no, pos) AS place FROM typed),
f AS (SELECT norm, text, count(*) AS n, min(place) AS place FROM placed GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, length(text) DESC, text) AS k, sum(n) OVER (PARTITION BY norm) AS total, min(place) OVER (PARTITION BY norm) AS ord FROM f),
keyed AS (SELECT lower(text) AS s, text, total, ord FROM r WHERE k = 1),
items AS (SELECT s, min(ord) AS ord FROM keyed GROUP BY s),{sql_leaders("items")},
g AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY length(text) DESC, ord) AS k FROM keyed JOIN led USING (s))
SELECT max(text) FILTER (WHERE k = 1) AS text, count(*) AS forms, CAST(sum(total) AS BIGINT) AS mentions FROM g GROUP BY leader""", recursive=True))
def _(spark, sf):
    return e.fuzzy_merge(cut_lineage(e.canonical(entity_rows(spark, sf)))).select("text", "forms", "mentions")


SQL_MAP_DIFFICULTY = """CASE WHEN {0} IS NULL OR {0} = '' THEN 0 WHEN regexp_matches(trim({0}), '^[0-9]+$') THEN least(5, CAST(trim({0}) AS INTEGER))
  WHEN contains(lower({0}), 'easy') THEN 1 WHEN contains(lower({0}), 'hard') THEN 5
  WHEN contains(lower({0}), 'medium') OR contains(lower({0}), 'moderate') THEN 3 WHEN len(regexp_extract_all({0}, '[^ ]+')) < 8 THEN 1 ELSE 3 END"""


@catalog.add("g11_cards_from_questions", with_views("note_lines note_items", f"""
, n AS (SELECT *, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'Easy one' WHEN 2 THEN 'moderate' ELSE CAST(p_size AS VARCHAR) END AS d FROM note_items)
SELECT note_id, i - 1 AS pos, 'What is ' || p_name || '?' AS question, 'A ' || p_type || ' part of ' || p_brand AS answer,
  CAST({SQL_MAP_DIFFICULTY.format("d")} AS BIGINT) AS difficulty FROM n"""))
def _(spark, sf):
    return c.cards_from_questions(pg.parsed_tables(spark, sf)["questions"]).select(
        "note_id", F.col("pos").cast("bigint").alias("pos"), "question", "answer", F.col("difficulty").cast("bigint").alias("difficulty")
    )


@catalog.add("g12_map_difficulty", f"""
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN replace(o_orderpriority, 'HIGH', 'Hard')
  WHEN 2 THEN left(o_orderpriority, 1) ELSE replace(replace(o_orderpriority, '5-LOW', ''), 'URGENT', 'easy a b c d e f g h') END AS t FROM orders)
SELECT o_orderkey, CAST({SQL_MAP_DIFFICULTY.format("t")} AS BIGINT) AS difficulty FROM d""")
def _(spark, sf):
    text = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN replace(o_orderpriority, 'HIGH', 'Hard')
      WHEN 2 THEN left(o_orderpriority, 1) ELSE replace(replace(o_orderpriority, '5-LOW', ''), 'URGENT', 'easy a b c d e f g h') END""")
    return read_table(spark, sf, "orders").select("o_orderkey", c.map_difficulty(text).cast("bigint").alias("difficulty"))


SQL["deck_cards"] = """
  SELECT l_orderkey AS note_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS card_id,
    CAST(l_quantity AS BIGINT) % 6 AS difficulty, CASE WHEN l_linenumber % 2 = 1 THEN 'parsed_question' ELSE 'generated' END AS source_type FROM lineitem"""
SQL["deck"] = """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY md5(card_id || '|42'), card_id) AS k FROM deck_cards WHERE difficulty BETWEEN 1 AND 4) WHERE k <= 3"""


def deck(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("note_id"),
        F.concat_ws("-", *[F.col(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("card_id"),
        (F.col("l_quantity").cast("bigint") % 6).alias("difficulty"),
        F.when(F.col("l_linenumber") % 2 == 1, "parsed_question").otherwise("generated").alias("source_type"),
    )
    return c.assemble_deck(rows.filter("source_type = 'parsed_question'"), rows.filter("source_type = 'generated'"), 1, 4, 3)


@catalog.add("g13_assemble_deck", with_views("deck_cards deck", """
SELECT note_id, card_id, difficulty, source_type, k AS "rank" FROM deck"""))
def _(spark, sf):
    return deck(spark, sf).select("note_id", "card_id", "difficulty", "source_type", F.col("rank").cast("bigint").alias("rank"))


@catalog.add("g13_cards_wanted", with_views("deck_cards", """
SELECT note_id, least(50, greatest(5, count(*))) AS cards_wanted FROM deck_cards WHERE source_type = 'parsed_question' GROUP BY note_id"""))
def _(spark, sf):
    rows = read_table(spark, sf, "lineitem").filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("note_id"))
    return c.cards_wanted(rows, least=5, most=50)


@catalog.add("g14_deck_stats", with_views("deck_cards deck", """
SELECT 'source_type' AS kind, source_type AS value, count(*) AS n FROM deck GROUP BY 2
UNION ALL SELECT 'difficulty', CAST(difficulty AS VARCHAR), count(*) FROM deck GROUP BY 2"""))
def _(spark, sf):
    return c.deck_stats(deck(spark, sf))


SQL["quiz_lines"] = f"""
  SELECT doc_id AS quiz_id, line_no AS idx, line AS question, ['MCQ', 'tf', 'essay', 'true_false'][line_no % 4 + 1] AS raw,
    ['easy', 'brutal', 'hard'][line_no % 3 + 1] AS level, CASE WHEN line_no % 5 = 0 THEN 1 ELSE line_no % 5 END AS points FROM lines"""


def quizzes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a quiz in the JSON form a model returns; its lines are the questions."""
    content = F.to_json(F.struct(F.transform(F.split("text", "\n"), lambda x, i: F.struct(
        x.alias("question"),
        F.get(F.array(*[F.lit(k) for k in ("MCQ", "tf", "essay", "true_false")]), i % 4).alias("type"),
        F.lit("x").alias("correct_answer"),
        F.get(F.array(*[F.lit(k) for k in ("easy", "brutal", "hard")]), i % 3).alias("difficulty"),
        F.when(i % 5 != 0, i % 5).alias("points"),
    )).alias("questions")))
    raw = read_table(spark, sf, "documents").select(F.col("doc_id").alias("quiz_id"), content.alias("content"))
    return raw.select("quiz_id", F.from_json("content", QUIZ_CONTENT)["questions"].alias("questions"))


@catalog.add("g15_normalize_quiz", with_views("lines quiz_lines", """
SELECT quiz_id, idx, question, CASE raw WHEN 'MCQ' THEN 'mcq' WHEN 'essay' THEN 'short_answer' ELSE 'true_false' END AS type,
  CASE WHEN level = 'brutal' THEN 'medium' ELSE level END AS difficulty, CAST(points AS BIGINT) AS points,
  CAST(sum(points) OVER (PARTITION BY quiz_id) AS BIGINT) AS total_points FROM quiz_lines"""))
def _(spark, sf):
    rows, totals = c.normalize_quiz(quizzes(spark, sf))
    return rows.join(totals, "quiz_id").select(
        "quiz_id", F.col("idx").cast("bigint").alias("idx"), "question", "type", "difficulty", F.col("points").cast("bigint").alias("points"), "total_points"
    )


SQL["graded"] = f"""
  SELECT quiz_id, idx, points, kind, coalesce(CASE kind WHEN 'mcq' THEN lower({sql_strip("ua")}) = lower({sql_strip("ca")})
      WHEN 'true_false' THEN CASE WHEN lower(ua) IN ('t', 'y') THEN 'true' WHEN lower(ua) IN ('f', 'n') THEN 'false' ELSE lower(ua) END
                           = CASE WHEN lower(ca) IN ('t', 'y') THEN 'true' WHEN lower(ca) IN ('f', 'n') THEN 'false' ELSE lower(ca) END
      ELSE len(list_filter(regexp_extract_all(lower(ca), {q(WORDS)}), lambda w: length(w) > 2 AND contains(lower({sql_strip("ua")}), w))) > 0 END, false) AS correct FROM (
    SELECT a.conv_id AS quiz_id, a.turn AS idx, 1 + a.turn % 3 AS points, ['mcq', 'true_false', 'short_answer'][(a.conv_id + a.turn) % 3 + 1] AS kind,
      CASE (a.conv_id + a.turn) % 3 WHEN 0 THEN split_part(b.text, ' ', 1) WHEN 1 THEN CASE WHEN length(b.text) % 2 = 0 THEN 't' ELSE 'False' END ELSE left(b.text, 40) END AS ca,
      CASE WHEN a.turn % 7 = 3 THEN NULL WHEN (a.conv_id + a.turn) % 3 = 0 THEN CASE WHEN a.conv_id % 2 = 0 THEN ' ' || upper(split_part(b.text, ' ', 1)) ELSE 'x' END
        WHEN (a.conv_id + a.turn) % 3 = 1 THEN ['T', 'false', 'y', 'n'][a.conv_id % 4 + 1] ELSE a.text END AS ua
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"""


def graded(spark: SparkSession, sf: str) -> DataFrame:
    cards = pg.qa_cards(spark, sf)
    kind = (F.col("conv_id") + F.col("turn")) % 3
    word = F.split_part("answer", F.lit(" "), F.lit(1))
    questions = cards.select(
        F.col("conv_id").alias("quiz_id"), F.col("turn").alias("idx"), (1 + F.col("turn") % 3).alias("points"),
        F.get(F.array(F.lit("mcq"), F.lit("true_false"), F.lit("short_answer")), kind.cast("int")).alias("type"),
        F.when(kind == 0, word).when(kind == 1, F.when(F.length("answer") % 2 == 0, "t").otherwise("False")).otherwise(F.substring("answer", 1, 40)).alias("correct_answer"),
    )
    answers = cards.select(
        F.col("conv_id").alias("attempt_id"), F.col("conv_id").alias("quiz_id"), F.col("turn").alias("idx"),
        F.when(F.col("turn") % 7 != 3, F.when(kind == 0, F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" "), upper_each(word))).otherwise("x"))
               .when(kind == 1, F.get(F.array(*[F.lit(x) for x in ("T", "false", "y", "n")]), (F.col("conv_id") % 4).cast("int")))
               .otherwise(F.col("question"))).alias("answer"),
    )
    return c.grade(questions, answers)


@catalog.add("g16_grade", with_views("graded", """
SELECT quiz_id AS attempt_id, idx, kind AS type, correct, CASE WHEN correct THEN points ELSE 0 END AS points_earned FROM graded"""))
def _(spark, sf):
    return graded(spark, sf).select("attempt_id", "idx", "type", "correct", "points_earned")


@catalog.add("g17_scores", with_views("graded", """
SELECT quiz_id AS attempt_id, CAST(sum(CASE WHEN correct THEN points ELSE 0 END) AS BIGINT) AS score, CAST(sum(points) AS BIGINT) AS max_score,
  count(*) FILTER (WHERE correct) AS correct_answers FROM graded GROUP BY quiz_id"""))
def _(spark, sf):
    return c.scores(graded(spark, sf))
