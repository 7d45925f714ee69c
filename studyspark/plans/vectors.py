"""Vector queries. The embeddings table serves as graph vertices: labels 0-2 are concepts, 3-4 topics,
5 entities, 6-9 flashcards. Random vectors are far apart, so the threshold is 0.3 here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.functions import vectors as fv
from studyspark.operators import vectors as ov
from studyspark.plans.registry import Catalog
from studyspark.plans.views import SQL, with_views
from studyspark.sources.tables import read_table

catalog = Catalog()
THRESHOLD = 0.3

SQL["nodes"] = """
  SELECT vec_id AS id, CASE WHEN label <= 2 THEN 'Concept' WHEN label <= 4 THEN 'Topic' WHEN label = 5 THEN 'Entity' ELSE 'Flashcard' END AS node_type,
         CASE WHEN label > 5 THEN 'flashcard-' ELSE 'node-' END || CAST(vec_id AS VARCHAR) AS label,
         CAST(embedding AS DOUBLE[]) AS vector
  FROM embeddings"""
COS = "list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector)))"
SQL["sims"] = f"""
  SELECT a.id AS card_id, b.id AS node_id, b.node_type, b.label, {COS} AS similarity
  FROM nodes a, nodes b WHERE a.node_type = 'Flashcard' AND b.node_type <> 'Flashcard'"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("CASE WHEN label <= 2 THEN 'Concept' WHEN label <= 4 THEN 'Topic' WHEN label = 5 THEN 'Entity' ELSE 'Flashcard' END")
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), kind.alias("node_type"),
        F.concat(F.when(F.col("label") > 5, "flashcard-").otherwise("node-"), F.col("vec_id").cast("string")).alias("label"),
        F.col("embedding").alias("vector"), F.col("vec_id").alias("embedding_id"),
    )


def cards_and_nodes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    every = nodes(spark, sf)
    return every.filter("node_type = 'Flashcard'"), every.filter("node_type <> 'Flashcard'")


@catalog.add("d1_embed")
def _(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return ov.embed(docs).select("doc_id", "vector")


@catalog.add("d2_fit_normalize", """
WITH f AS (SELECT vec_id, 'cut' AS kind, CAST(embedding[1:48] AS DOUBLE[]) AS v FROM embeddings
  UNION ALL SELECT vec_id, 'padded', CAST(embedding || list_transform(range(32), lambda x: CAST(0 AS FLOAT)) AS DOUBLE[]) FROM embeddings),
n AS (SELECT vec_id, kind, v, sqrt(list_dot_product(v, v)) AS s FROM f)
SELECT vec_id, kind, i AS pos, round(CASE WHEN s > 0 THEN v[i + 1] / s ELSE 0 END, 6) AS x FROM n, unnest(range(len(v))) AS u(i)""")
def _(spark, sf):
    base = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    both = ov.fit_normalize(base, 48).withColumn("kind", F.lit("cut")).unionByName(
        ov.fit_normalize(base, 96).withColumn("kind", F.lit("padded"))
    )
    return both.select("vec_id", "kind", F.posexplode("vector").alias("pos", "x")).select(
        "vec_id", "kind", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x")
    )


@catalog.add("d3_cosine", f"""
WITH b AS (SELECT vec_id + 1 AS vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)
SELECT a.vec_id, round({COS}, 6) AS similarity FROM a JOIN b ON a.vec_id = b.vec_id""")
def _(spark, sf):
    a = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = a.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(fv.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


TOP_SQL = """, r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY similarity DESC, {tie}) AS rk FROM sims)"""


@catalog.add("d4_top_k_similar", with_views("nodes sims", TOP_SQL.format(by="card_id", tie="node_id") + """
SELECT card_id, node_id, round(similarity, 6) AS similarity, rk AS "rank" FROM r WHERE rk <= 5"""))
def _(spark, sf):
    cards, others = cards_and_nodes(spark, sf)
    return ov.top_k_similar(cards, others).select(
        F.col("id_a").alias("card_id"), F.col("id_b").alias("node_id"), F.round("similarity", 6).alias("similarity"),
        F.col("rank").cast("bigint").alias("rank"),
    )


@catalog.add("d5_similar_pairs", with_views("nodes sims", f"""
SELECT card_id, node_id, round(similarity, 6) AS similarity FROM sims WHERE similarity > {THRESHOLD}"""))
def _(spark, sf):
    cards, others = cards_and_nodes(spark, sf)
    return ov.similar_pairs(cards, others, THRESHOLD).select(
        F.col("id_a").alias("card_id"), F.col("id_b").alias("node_id"), F.round("similarity", 6).alias("similarity")
    )


@catalog.add("d6_latest_embedding", """
SELECT label AS entity_type, vec_id // 4 AS entity_id, max(vec_id) AS id,
  CAST(list_sum(list_transform(arg_max(embedding, vec_id), lambda e, i: CAST(floor(CAST(e AS DOUBLE) * 1000000) AS BIGINT) * i)) AS BIGINT) AS vector_sum
FROM embeddings GROUP BY 1, 2""")
def _(spark, sf):
    rows = read_table(spark, sf, "embeddings").select(
        F.col("label").alias("entity_type"), F.expr("vec_id div 4").alias("entity_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )
    weighted = F.transform("vector", lambda e, i: F.floor(e.cast("double") * 1000000) * (i + 1))      # every element counts, by its place
    return ov.latest_embedding(rows).select("entity_type", "entity_id", "id", F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("vector_sum"))


@catalog.add("d7_cards_for_nodes", with_views("nodes sims", TOP_SQL.format(by="node_id", tie="card_id") + """
SELECT label AS node_label, card_id, round(similarity, 6) AS similarity, rk AS "rank" FROM r WHERE rk <= 5"""))
def _(spark, sf):
    cards, others = cards_and_nodes(spark, sf)
    vectors = nodes(spark, sf).select("id", "vector")
    return ov.cards_for_nodes(others, cards, vectors).select(
        "node_label", "card_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank")
    )


@catalog.add("d8_nodes_for_cards", with_views("nodes sims", TOP_SQL.format(by="card_id", tie="node_id") + """
SELECT card_id, node_id, label, node_type, round(similarity, 6) AS similarity, rk AS "rank" FROM r WHERE rk <= 3"""))
def _(spark, sf):
    cards, _ = cards_and_nodes(spark, sf)
    every = nodes(spark, sf)
    return ov.nodes_for_cards(cards, every, every.select("id", "vector"), 3).select(
        "card_id", "node_id", "label", "node_type", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank")
    )


@catalog.add("d9_cluster_cards")
def _(spark, sf):
    cards, _ = cards_and_nodes(spark, sf)
    return ov.cluster_cards(cards)


@catalog.add("d10_link_stats", with_views("nodes sims", f"""
SELECT count(*) AS links, count(DISTINCT card_id) AS cards, count(DISTINCT node_id) AS nodes, round(coalesce(avg(similarity), 0), 6) AS avg_similarity
FROM sims WHERE similarity > {THRESHOLD}"""))
def _(spark, sf):
    cards, others = cards_and_nodes(spark, sf)
    return ov.link_stats(ov.similar_groups(cards, others, THRESHOLD)).withColumn("avg_similarity", F.round("avg_similarity", 6))
