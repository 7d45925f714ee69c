"""Graph construction queries over the chunk corpus, the embeddings and parsed notes made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.operators import graph_build as g
from studyspark.operators.entities import attach_entities
from studyspark.operators.text_prep import chunk_metadata
from studyspark.plans import vectors as pv
from studyspark.plans.entities import TYPED
from studyspark.plans.registry import Catalog
from studyspark.plans.text import chunks as plain_chunks
from studyspark.plans.text import chunk_rows, has, q, sql_strip
from studyspark.plans.views import SQL, with_views
from studyspark.sources.parsed import explode_parsed, parse_content
from studyspark.session import cut_lineage, written
from studyspark.sources.tables import read_table

catalog = Catalog()


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table with entities, written once, for queries that read it several times."""
    return cut_lineage(attach_entities(headed_chunks(spark, sf)))


def headed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table without entities, for queries that need none: only the columns in use are computed."""
    return plain_chunks(spark, sf).withColumn("heading_level", F.length(F.regexp_extract("text", "^(#+)", 1)))


PARTS = r"string_split(regexp_replace(c.text, '([.!?])[\t-\r ]+', '\1' || chr(10), 'g'), chr(10))"
SQL["concepts"] = f"""
  SELECT label, text, doc_id, chunk_no, {sql_strip("coalesce(list_filter(parts, lambda s: contains(lower(s), lower(label)))[1], parts[1], '')")} AS definition
  FROM (SELECT label, c.text, doc_id, chunk_no, {PARTS} AS parts
        FROM (SELECT text AS label, doc_id, chunk_no, row_number() OVER (PARTITION BY text ORDER BY doc_id, chunk_no, pos) AS k
              FROM typed WHERE type IN ('Concept', 'Topic')) f JOIN chunks c USING (doc_id, chunk_no) WHERE k = 1)"""
SQL["topics"] = f"""
  SELECT topic AS label, {sql_strip("text")} AS description, first_doc, first_chunk FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY type <> 'paragraph', doc_id, chunk_no) AS k,
      first_value(doc_id) OVER w AS first_doc, first_value(chunk_no) OVER w AS first_chunk
    FROM chunks WHERE topic <> '' WINDOW w AS (PARTITION BY topic ORDER BY doc_id, chunk_no)) WHERE k = 1"""
SQL["entities"] = """
  SELECT label, type AS entity_type FROM (
    SELECT text AS label, type, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC, chunk_no DESC, pos DESC) AS k
    FROM typed WHERE type IN ('Entity', 'Formula')) WHERE k = 1"""
SQL["resolved"] = """
  SELECT label, CASE min(p) WHEN 0 THEN 'Concept' WHEN 1 THEN 'Topic' ELSE 'Entity' END AS node_type FROM (
    SELECT label, 0 AS p FROM concepts UNION ALL SELECT label, 1 FROM topics UNION ALL SELECT label, 2 FROM entities) GROUP BY label"""
SQL["topic_only"] = "SELECT t.* FROM topics t JOIN resolved r ON r.label = t.label AND r.node_type = 'Topic'"
SQL["spans"] = f"""
  SELECT doc_id, chunk_no, text, 'formula:' || {sql_strip("u.f")} AS formula
  FROM (SELECT *, regexp_extract_all(text, {q(fx.FORMULA_SPAN)}, 0) AS fs FROM chunks WHERE has_formula), unnest(fs) AS u(f)"""
SQL["qa"] = """
  SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS card_id, a.text AS question, b.text AS answer
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'"""
SQL["card_edges"] = """
  SELECT 'flashcard-' || card_id AS source, label AS target, 'DERIVED_FROM' AS type, CAST(1 AS DOUBLE) AS weight
  FROM qa JOIN resolved ON label <> '' AND contains(lower(question || chr(1) || answer || chr(1)), lower(label))"""
CONCEPTS = TYPED + " concepts"
NODES = CONCEPTS + " topics entities resolved"


def qa_cards(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn right after them, found by an equi-join on the turn number."""
    turns = read_table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answered = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("card_id"),
        "question", "answer", F.lit(None).cast("string").alias("context"), "conv_id", "turn",
    )


def node_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The resolved nodes without their texts: nothing of the chunks is written for them."""
    return g.node_labels(attach_entities(headed_chunks(spark, sf)))


def resolved_nodes(chunk_df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All nodes, and the topics that stay Topic nodes."""
    topics = g.topic_nodes(chunk_df)
    nodes = g.resolve_nodes(g.concept_nodes(chunk_df), topics, g.entity_nodes(chunk_df))
    kept = topics.join(nodes.filter("node_type = 'Topic'").select("label"), "label", "left_semi")
    return nodes, kept, topics


@catalog.add("e1_concept_nodes", with_views(CONCEPTS, " SELECT label, text, doc_id FROM concepts"))
def _(spark, sf):
    return g.concept_nodes(chunks(spark, sf)).select("label", "text", "first.doc_id")


@catalog.add("e2_topic_nodes", with_views(TYPED + " topics", """
, p AS (SELECT topic AS label, string_agg(text, '|' ORDER BY k) AS key_points FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id, chunk_no) AS k FROM chunks WHERE type = 'list') WHERE k <= 10 GROUP BY topic)
SELECT label, description, coalesce(key_points, '') AS key_points FROM topics LEFT JOIN p USING (label)"""))
def _(spark, sf):
    return g.topic_nodes(headed_chunks(spark, sf)).select("label", "description", F.array_join("key_points", "|").alias("key_points"))


@catalog.add("e3_entity_nodes", with_views(TYPED + " entities", " SELECT label, entity_type FROM entities"))
def _(spark, sf):
    return g.entity_nodes(attach_entities(headed_chunks(spark, sf))).select("label", "entity_type")


@catalog.add("e4_definitions", with_views(CONCEPTS, " SELECT label, definition FROM concepts"))
def _(spark, sf):
    return g.definitions(g.concept_nodes(chunks(spark, sf))).select("label", "definition")


@catalog.add("e5_examples", f"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip("x")}),
  lambda x: starts_with(lower(x), 'e.g.') OR starts_with(lower(x), 'example') OR starts_with(lower(x), 'for instance')) AS e FROM documents)
SELECT doc_id, len(e[1:5]) AS n, array_to_string(e[1:5], '|') AS examples FROM t""")
def _(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return g.examples(docs).select("doc_id", F.size("examples").cast("bigint").alias("n"), F.array_join("examples", "|").alias("examples"))


@catalog.add("e6_resolve_nodes", with_views(NODES, " SELECT label, node_type FROM resolved"))
def _(spark, sf):
    return resolved_nodes(chunks(spark, sf))[0]


@catalog.add("e7_related_by_embedding", with_views("nodes", f"""
SELECT a.id AS source, b.id AS target, 'RELATED_TO' AS type, round({pv.COS}, 6) AS weight
FROM nodes a, nodes b WHERE a.node_type = 'Concept' AND b.node_type = 'Concept' AND a.id <> b.id AND {pv.COS} > {pv.THRESHOLD}"""))
def _(spark, sf):
    concepts = pv.nodes(spark, sf).filter("node_type = 'Concept'")
    return g.related_by_embedding(concepts, pv.THRESHOLD).withColumn("weight", F.round("weight", 6))


@catalog.add("e8_related_by_definition", with_views(CONCEPTS, """
SELECT a.label AS source, b.label AS target, 'RELATED_TO' AS type, CAST(0.8 AS DOUBLE) AS weight
FROM concepts a JOIN concepts b ON a.label <> b.label AND contains(lower(a.definition), lower(b.label))"""))
def _(spark, sf):
    return g.related_by_definition(g.definitions(g.concept_nodes(chunks(spark, sf))))


@catalog.add("e9_part_of_by_heading", with_views(NODES + " topic_only", """
, o AS (SELECT type, topic, lead(topic) OVER (PARTITION BY doc_id ORDER BY length(regexp_extract(text, '^(#+)', 1)), chunk_no) AS child FROM chunks)
SELECT child AS source, topic AS target, 'PART_OF' AS type, CAST(1 AS DOUBLE) AS weight FROM o
WHERE type = 'heading' AND topic IN (SELECT label FROM topic_only) AND child IN (SELECT label FROM topic_only)"""))
def _(spark, sf):
    rows = cut_lineage(attach_entities(headed_chunks(spark, sf)).select("doc_id", "chunk_no", "type", "topic", "heading_level", "entities"))
    return g.part_of_by_heading(rows, g.topic_labels(rows))


@catalog.add("e10_part_of_by_description", with_views(NODES + " topic_only", """
SELECT b.label AS source, a.label AS target, 'PART_OF' AS type, CAST(0.9 AS DOUBLE) AS weight
FROM topic_only a JOIN topic_only b ON a.label <> b.label AND contains(lower(a.description), lower(b.label))"""))
def _(spark, sf):
    # The chunks are written without their texts; those of the describing chunks are cut again, which takes no shuffle of all topics.
    rows = cut_lineage(attach_entities(headed_chunks(spark, sf)).select("doc_id", "chunk_no", "type", "topic", "entities"))
    texts = chunk_metadata(chunk_rows(spark, sf)).select("doc_id", "chunk_no", "text")
    return g.part_of_by_description(g.topic_descriptions(rows, texts))


@catalog.add("e11_formula_nodes", with_views(TYPED + " spans", " SELECT DISTINCT formula AS label, 'Formula' AS node_type FROM spans"))
def _(spark, sf):
    return g.formula_nodes(headed_chunks(spark, sf))


@catalog.add("e12_explains_edges", with_views(NODES + " spans", """
SELECT label AS source, formula AS target, 'EXPLAINS' AS type, CAST(0.6 AS DOUBLE) AS weight
FROM spans JOIN resolved ON node_type IN ('Concept', 'Topic') AND label <> '' AND contains(lower(text), lower(label)) AND label <> formula"""))
def _(spark, sf):
    rows = chunks(spark, sf)
    return g.explains_edges(rows, g.node_labels(rows))


@catalog.add("e13_cards_to_nodes", with_views(NODES + " qa card_edges", " SELECT * FROM card_edges"))
def _(spark, sf):
    return g.cards_to_nodes(qa_cards(spark, sf), node_labels(spark, sf))


@catalog.add("e14_fallback_topic", with_views(NODES + " topic_only qa", """
, e AS (SELECT DISTINCT card_id FROM qa JOIN resolved ON contains(lower(question || chr(1) || answer || chr(1)), lower(label))),
f AS (SELECT label FROM topic_only ORDER BY first_doc, first_chunk, label LIMIT 1)
SELECT 'flashcard-' || card_id AS source, f.label AS target, 'DERIVED_FROM' AS type, CAST(0.5 AS DOUBLE) AS weight
FROM qa, f WHERE card_id NOT IN (SELECT card_id FROM e)"""))
def _(spark, sf):
    cards, nodes = qa_cards(spark, sf), cut_lineage(node_labels(spark, sf))
    return g.fallback_topic(cards, g.cards_to_nodes(cards, nodes), nodes.filter("node_type = 'Topic'"))


LINK = "CASE WHEN node_type = 'Topic' THEN 'EXPLAINS' ELSE 'DERIVED_FROM' END"


@catalog.add("e15_semantic_edges", with_views("nodes sims", f"""
SELECT card_id AS source, node_id AS target, {LINK} AS type, round(similarity, 6) AS weight FROM sims
WHERE similarity > {pv.THRESHOLD} AND NOT (similarity > 0.35 AND node_type <> 'Topic')"""))
def _(spark, sf):
    cards, others = pv.cards_and_nodes(spark, sf)
    edges = cut_lineage(g.semantic_edges(cards, others, threshold=pv.THRESHOLD))      # the strong ones are among them
    return g.new_edges(edges, edges.filter("weight > 0.35 AND type = 'DERIVED_FROM'")).select("source", "target", "type", F.round("weight", 6).alias("weight"))


@catalog.add("e16_min_one_link", with_views("nodes sims", f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY similarity DESC, node_id) AS k FROM sims
        WHERE card_id NOT IN (SELECT card_id FROM sims WHERE similarity > {pv.THRESHOLD}))
SELECT card_id AS source, node_id AS target, {LINK} AS type, round(similarity, 6) AS weight FROM r WHERE k = 1"""))
def _(spark, sf):
    cards, others = pv.cards_and_nodes(spark, sf)
    return g.min_one_link(cards, others, g.semantic_edges(cards, others, threshold=pv.THRESHOLD)).withColumn("weight", F.round("weight", 6))


@catalog.add("e17_graph_stats", with_views(NODES + " qa card_edges", """
SELECT 'node' AS kind, node_type AS type, count(*) AS n FROM resolved GROUP BY 2
UNION ALL SELECT 'edge', type, count(*) FROM card_edges GROUP BY 2"""))
def _(spark, sf):
    nodes = cut_lineage(node_labels(spark, sf))
    return g.graph_stats(nodes, g.cards_to_nodes(qa_cards(spark, sf), nodes))


SQL["note_lines"] = """
  SELECT l_orderkey AS note_id, o_orderpriority, o_orderstatus,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i,
    p_name, p_brand, p_type, p_size, p_partkey, l_returnflag, l_quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
SQL["note_items"] = """
  SELECT *, lead(p_name) OVER (PARTITION BY note_id ORDER BY i) AS next_name,
    'Line ' || CAST(i AS VARCHAR) AS subtopic, 'Ship ' || p_name || ' with q=' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ';' AS content,
    'q=' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ';' AS latex, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS formula_text
  FROM note_lines"""


def note_lines(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    parts = read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return read_table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )


def parsed_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a parsed note: its lines are subtopics, formulas, concepts and questions. Odd orders
    use the alternate keys."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "p_name", "p_brand", "p_type", "p_size", "l_returnflag")
    notes = note_lines(spark, sf).groupBy("l_orderkey", "o_orderpriority", "o_orderstatus").agg(F.array_sort(F.collect_list(row)).alias("x"))
    odd = F.col("l_orderkey") % 2 == 1

    def alternate(value, first: str, second: str):
        return [F.when(~odd, value).alias(first), F.when(odd, value).alias(second)]

    def qty(x):
        return F.concat(F.lit("q="), x["l_quantity"].cast("bigint").cast("string"), F.lit(";"))

    subtopics = F.transform("x", lambda x, i: F.struct(
        *alternate(F.concat(F.lit("Line "), (i + 1).cast("string")), "title", "name"),
        F.concat(F.lit("Ship "), x["p_name"], F.lit(" with "), qty(x)).alias("content"),
        F.array(x["l_returnflag"]).alias("key_points"),
    ))
    content = F.struct(
        F.array(F.struct(
            *alternate(F.col("o_orderpriority"), "title", "name"),
            F.concat(F.lit("Status "), F.col("o_orderstatus")).alias("description"), subtopics.alias("subtopics"),
        )).alias("topics"),
        F.transform("x", lambda x: F.struct(
            *alternate(qty(x), "latex", "expression"), F.when(x["p_size"] % 3 != 0, x["p_type"]).alias("description"),
        )).alias("formulas"),
        F.transform("x", lambda x, i: F.struct(
            *alternate(x["p_name"], "name", "label"),
            F.concat(x["p_type"], F.lit(" goes with "), F.coalesce(F.get("x", i + 1)["p_name"], F.lit("nothing"))).alias("definition"),
            F.array(F.concat(F.lit("see "), x["p_brand"])).alias("examples"),
        )).alias("key_concepts"),
        F.transform("x", lambda x: F.struct(
            *alternate(F.concat(F.lit("What is "), x["p_name"], F.lit("?")), "question", "q"),
            *alternate(F.concat(F.lit("A "), x["p_type"], F.lit(" part of "), x["p_brand"]), "answer", "a"),
            F.when(x["p_size"] % 4 == 0, F.lit("")).when(x["p_size"] % 4 == 1, F.lit("Easy one"))
            .when(x["p_size"] % 4 == 2, F.lit("moderate")).otherwise(x["p_size"].cast("string")).alias("difficulty"),
        )).alias("questions"),
    )
    return notes.select(F.col("l_orderkey").alias("note_id"), F.to_json(content).alias("parsed_content"))


def parsed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The parsed notes, which are parsed and written once."""
    return written(parse_content(parsed_notes(spark, sf)), "parsed-notes")


def parsed_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The item tables of the parsed notes: every item table reads its own columns."""
    return explode_parsed(parsed_rows(spark, sf))


@catalog.add("a5_explode_parsed", with_views("note_lines note_items", """
SELECT 'topic' AS kind, note_id, 0 AS pos, max(o_orderpriority) AS name, max('Status ' || o_orderstatus) AS detail FROM note_items GROUP BY note_id
UNION ALL SELECT 'subtopic', note_id, i - 1, subtopic, content FROM note_items
UNION ALL SELECT 'formula', note_id, i - 1, latex, formula_text FROM note_items
UNION ALL SELECT 'concept', note_id, i - 1, p_name, p_type || ' goes with ' || coalesce(next_name, 'nothing') FROM note_items
UNION ALL SELECT 'question', note_id, i - 1, 'What is ' || p_name || '?', 'A ' || p_type || ' part of ' || p_brand FROM note_items"""))
def _(spark, sf):
    t = parsed_tables(spark, sf)

    def shape(kind: str, df: DataFrame, pos: str, name: str, detail: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "note_id", F.col(pos).cast("bigint").alias("pos"), F.col(name).alias("name"),
                         F.coalesce(detail, F.lit("")).alias("detail"))

    return (
        shape("topic", t["topics"], "topic_no", "name", "description")
        .unionByName(shape("subtopic", t["subtopics"], "subtopic_no", "name", "content"))
        .unionByName(shape("formula", t["formulas"], "pos", "latex", "description"))
        .unionByName(shape("concept", t["concepts"], "pos", "name", "definition"))
        .unionByName(shape("question", t["questions"], "pos", "question", "answer"))
    )


@catalog.add("e18_parsed_graph", with_views("note_lines note_items", """
, n AS (SELECT note_id, 'Topic' AS node_type, o_orderpriority AS label FROM note_items UNION SELECT note_id, 'Subtopic', subtopic FROM note_items
  UNION SELECT note_id, 'Concept', p_name FROM note_items UNION SELECT note_id, 'Formula', latex FROM note_items)
SELECT note_id, node_type AS kind, label AS source, '' AS target FROM n
UNION ALL SELECT note_id, 'CONTAINS', o_orderpriority, subtopic FROM note_items"""))
def _(spark, sf):
    nodes, edges = g.parsed_graph(parsed_tables(spark, sf))
    return nodes.select("note_id", F.col("node_type").alias("kind"), F.col("label").alias("source"), F.lit("").alias("target")).unionByName(
        edges.select("note_id", F.col("type").alias("kind"), "source", "target")
    )


@catalog.add("e19_relates_to", with_views("note_lines note_items", """
SELECT a.note_id, a.p_name AS source, b.p_name AS target, 'RELATES_TO' AS type, count(DISTINCT a.i) AS places
FROM note_items a JOIN note_items b ON a.note_id = b.note_id AND lower(a.p_name) <> lower(b.p_name)
 AND contains(lower(a.p_type || ' goes with ' || coalesce(a.next_name, 'nothing') || ' see ' || a.p_brand), lower(b.p_name)) GROUP BY ALL"""))
def _(spark, sf):
    found = g.relates_to(parsed_tables(spark, sf)["concepts"])
    return found.groupBy("note_id", "source", "target", "type").agg(F.count("*").alias("places"))


SQL["uses"] = """
  SELECT DISTINCT f.note_id, f.latex AS source, f.o_orderpriority AS target
  FROM note_items f JOIN (SELECT note_id, max('Status ' || o_orderstatus) || ' ' || string_agg(content, ' ' ORDER BY i) AS text FROM note_items GROUP BY note_id) t
    ON f.note_id = t.note_id AND (contains(t.text, f.latex) OR (f.formula_text <> '' AND contains(t.text, f.formula_text)))"""


@catalog.add("e20_used_in", with_views("note_lines note_items uses", " SELECT note_id, source, target FROM uses"))
def _(spark, sf):
    return g.used_in_notes(parsed_rows(spark, sf)).select("note_id", "source", "target")


LEVEL = "least(4, (p_size - 1) // 10)"
SQL["note_concepts"] = f"""
  SELECT DISTINCT note_id, 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name, {LEVEL} AS lv FROM note_lines"""
SQL["prereqs"] = """
  SELECT a.note_id, a.name AS source, b.name AS target FROM note_concepts a JOIN note_concepts b ON a.note_id = b.note_id AND a.lv < b.lv"""


def note_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """An order is a note and its parts are the concepts; the part size gives the level. A note's
    concepts are bounded by its lines, so edges grow linearly with the tables."""
    scale = F.array(*[F.lit(x) for x in fx.LEVEL_ORDER])
    level = F.get(scale, F.least(F.lit(4), F.expr("(p_size - 1) div 10")).cast("int"))
    return note_lines(spark, sf).select(
        F.col("l_orderkey").alias("note_id"), F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("name"), level.alias("level")
    ).distinct()


@catalog.add("e21_prerequisites", with_views("note_lines note_concepts prereqs", " SELECT note_id, source, target FROM prereqs"))
def _(spark, sf):
    return g.prerequisites(note_concepts(spark, sf)).select("note_id", "source", "target")


SQL["map_nodes"] = """
  SELECT note_id AS map_id, i AS pos, CASE WHEN p_partkey % 5 = 0 THEN substr(md5(CAST(note_id AS VARCHAR) || '|' || CAST(i AS VARCHAR)), 1, 12)
    ELSE 'n' || CAST(i AS VARCHAR) END AS id FROM note_lines"""


@catalog.add("e22_clean_mindmap", with_views("note_lines map_nodes", """
SELECT map_id, 'node' AS kind, id AS source, '' AS target FROM map_nodes
UNION ALL SELECT map_id, 'root', id, '' FROM map_nodes WHERE pos = 1
UNION ALL SELECT a.map_id, 'edge', 'n' || CAST(a.pos AS VARCHAR), 'n' || CAST(a.pos + 1 AS VARCHAR) FROM map_nodes a
  JOIN map_nodes s ON s.map_id = a.map_id AND s.id = 'n' || CAST(a.pos AS VARCHAR)
  JOIN map_nodes t ON t.map_id = a.map_id AND t.id = 'n' || CAST(a.pos + 1 AS VARCHAR)"""))
def _(spark, sf):
    from pyspark.sql import Window
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = note_lines(spark, sf).select(F.col("l_orderkey").alias("map_id"), F.row_number().over(order).alias("pos"), "p_partkey")
    nodes = rows.select("map_id", "pos", F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("n"), F.col("pos").cast("string"))).alias("id"))
    edges = rows.select("map_id", F.concat(F.lit("n"), F.col("pos").cast("string")).alias("source"), F.concat(F.lit("n"), (F.col("pos") + 1).cast("string")).alias("target"))
    filled, kept, roots = g.clean_mindmap(nodes, edges)
    return (
        filled.select("map_id", F.lit("node").alias("kind"), F.col("id").alias("source"), F.lit("").alias("target"))
        .unionByName(roots.select("map_id", F.lit("root").alias("kind"), F.col("root_node_id").alias("source"), F.lit("").alias("target")))
        .unionByName(kept.select("map_id", F.lit("edge").alias("kind"), "source", "target"))
    )
