"""Source and sink queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.plans import cards as pc
from studyspark.plans import graph_query as pgq
from studyspark.plans import vectors as pv
from studyspark.plans.registry import Catalog
from studyspark.plans.text import has
from studyspark.plans.views import SQL, stamp, with_views
from studyspark.schemas import LOG_EVENTS
from studyspark.session import scratch_path, shared_dir
from studyspark.sources import sinks, tables

catalog = Catalog()


@catalog.add("a1_read_corpus", f"""
SELECT doc_id, CASE WHEN {has("text", r"(?m)^(#+ |```)|\[[^\]]+\]\([^)]+\)")} THEN 'markdown'
  WHEN {has("text", r"Page [0-9]+|[A-Za-z]-\n[A-Za-z]")} THEN 'pdf' ELSE 'plain' END AS fmt, length(text) AS chars FROM documents""")
def _(spark, sf):
    docs = tables.tag_format(tables.read_table(spark, sf, "documents"))
    return docs.select("doc_id", "fmt", F.length("text").cast("bigint").alias("chars"))


#: A number summed up per table, so that every file is read.
SUMMED = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_acctbal", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_totalprice", "lineitem": "l_extendedprice", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}


@catalog.add("a2_read_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n, round(CAST(sum({c}) AS DOUBLE), 2) AS total FROM {t}" for t, c in SUMMED.items()))
def _(spark, sf):
    t = tables.read_tables(spark, sf)
    totals = [
        t[name].agg(F.count("*").alias("n"), F.round(F.sum(column).cast("double"), 2).alias("total")).select(F.lit(name).alias("name"), "n", "total")
        for name, column in SUMMED.items()
    ]
    return reduce(DataFrame.unionByName, totals)


#: Per event name the number that its lines carry here, besides the first field, which names the event's type.
LOG_NUMBERS = {
    "http_request": "status_code", "llm_call": "prompt_tokens", "ocr_result": "text_length", "ocr_fallback_chain": "final_confidence", "summarization": "brief_word_count",
    "flashcard_generation": "flashcard_count", "quiz_generation": "question_count", "mindmap_generation": "node_count",
}
EVENT_NAMES = list(LOG_EVENTS)


@catalog.add("a4_log_events", f"""
SELECT [{", ".join(f"'{n}'" for n in EVENT_NAMES)}][event_id % {len(EVENT_NAMES)} + 1] AS event, event_type AS name, count(*) AS lines,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last FROM events GROUP BY ALL""")
def _(spark, sf):
    # Every event as a JSON line of one of all kinds of log events, written and read back.
    k, line = F.get_json_object("props", "$.k").cast("int"), F.lit(None).cast("string")
    for i, name in enumerate(EVENT_NAMES):
        first = LOG_EVENTS[name].split()[0]
        fields = F.struct(F.lit(name).alias("message"), F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias(first), k.alias(LOG_NUMBERS[name]))
        line = F.when(F.col("event_id") % len(EVENT_NAMES) == i, F.to_json(fields)).otherwise(line)
    target = scratch_path(spark, "logs")
    tables.read_table(spark, sf, "events").select(line.alias("value")).write.text(target)
    logs, parts = tables.read_logs(spark, target), None
    for name in EVENT_NAMES:
        part = tables.log_events(logs, name).select(F.lit(name).alias("event"), F.col(LOG_EVENTS[name].split()[0]).alias("name"), F.col(LOG_NUMBERS[name]).cast("bigint").alias("k"), "ts")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("event", "name").agg(F.count("*").alias("lines"), F.sum("k").alias("k_sum"), stamp(F.max("ts")).alias("last"))


@catalog.add("a6_graph_export", with_views("nodes kg_edges", """
SELECT 'node' AS kind, node_type AS type, count(*) AS n, count(*) FILTER (WHERE id % 10 <> 0) AS with_properties FROM nodes GROUP BY 2
UNION ALL SELECT 'edge', 'RELATED_TO', count(*), 0 FROM kg_edges"""))
def _(spark, sf):
    # Written as JSON lines and read back; every tenth node has broken properties.
    props = F.when(F.col("id") % 10 != 0, F.to_json(F.struct(F.col("label").alias("name")))).otherwise("{broken")
    nodes = pv.nodes(spark, sf).select("id", "node_type", "label", props.alias("properties"))
    path = f"{shared_dir(spark)}/graph-export-{uuid.uuid4().hex}"
    sinks.write_graph_json(nodes, pgq.kg_edges(spark, sf), path)
    back = spark.read.schema("id BIGINT, node_type STRING, label STRING, properties MAP<STRING, STRING>").json(f"{path}/nodes")
    edges = spark.read.schema("source BIGINT, target BIGINT, type STRING, weight DOUBLE").json(f"{path}/edges")
    filled = F.count_if(F.coalesce(F.size("properties"), F.lit(0)) > 0)
    return back.groupBy(F.col("node_type").alias("type")).agg(F.count("*").alias("n"), filled.alias("with_properties")).select(
        F.lit("node").alias("kind"), "type", "n", "with_properties"
    ).unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n", F.lit(0).cast("bigint").alias("with_properties")))


@catalog.add("a7_deck_export", with_views("deck_cards deck", """
SELECT (SELECT count(*) FROM deck) AS total_flashcards, 'source_type' AS kind, source_type AS value, count(*) AS n FROM deck GROUP BY 3
UNION ALL SELECT (SELECT count(*) FROM deck), 'difficulty', CAST(difficulty AS VARCHAR), count(*) FROM deck GROUP BY 3"""))
def _(spark, sf):
    path = f"{shared_dir(spark)}/deck-export-{uuid.uuid4().hex}"
    sinks.write_deck(pc.deck(spark, sf), path)
    meta = spark.read.schema("total_flashcards BIGINT, by_difficulty MAP<STRING, BIGINT>, by_source_type MAP<STRING, BIGINT>").json(f"{path}/metadata")
    return meta.select("total_flashcards", F.lit("difficulty").alias("kind"), F.explode("by_difficulty").alias("value", "n")).unionByName(
        meta.select("total_flashcards", F.lit("source_type").alias("kind"), F.explode("by_source_type").alias("value", "n"))
    )


@catalog.add("a8_append_new", """
SELECT o_custkey AS id, min(o_orderkey) AS first_order FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def _(spark, sf):
    target = tables.read_table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    batch = tables.read_table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_order"))
    return sinks.append_new(target, batch, ["id"], ["first_order"])


@catalog.add("a9_merge_results", """
SELECT doc_id AS note_id, CASE WHEN toxic = 0 THEN 'q' || CAST(quality AS VARCHAR) ELSE 'old ' || lang END AS summary,
  CASE WHEN labels.doc_id IS NOT NULL THEN 'completed' ELSE 'pending' END AS status FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, sf):
    notes = tables.read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("note_id"), F.concat(F.lit("old "), "lang").alias("summary"), F.lit("pending").alias("status")
    )
    results = tables.read_table(spark, sf, "labels").select(
        F.col("doc_id").alias("note_id"), F.when(F.col("toxic") == 0, F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("summary"),
        F.lit("completed").alias("status"),
    )
    return sinks.merge_results(notes, results)
