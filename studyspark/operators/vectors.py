"""Embeddings: making, storing, comparing and clustering vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.functions import vectors as fv
from studyspark.operators import vector_join

LINKABLE = ("Concept", "Topic", "Entity")


def embed(df: DataFrame, column: str = "text", dim: int = fv.DEFAULT_DIM, out: str = "vector") -> DataFrame:
    return df.withColumn(out, fv.hash_embedding(fv.text_seed(F.col(column)), dim))


def fit_normalize(df: DataFrame, dim: int, column: str = "vector") -> DataFrame:
    return df.withColumn(column, fv.fit_normalize(F.col(column), dim))


def latest_embedding(df: DataFrame) -> DataFrame:
    """The vector with the highest id per (entity_type, entity_id)."""
    return df.groupBy("entity_type", "entity_id").agg(F.max("id").alias("id"), F.max_by("vector", "id").alias("vector"))


def top_k_similar(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    return vector_join.top_k(queries, vectors, k)


def _copies(df: DataFrame) -> DataFrame:
    """Equal vectors as one row: the least id stands for all, with their number."""
    return df.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def similar_groups(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Similar pairs between groups of equal vectors: id_a, id_b, similarity, copies_a, copies_b."""
    ga, gb = _copies(a), _copies(b)
    pairs = vector_join.pairs_above(ga, gb, threshold)
    return (
        pairs.join(ga.select(F.col("id").alias("id_a"), F.col("copies").alias("copies_a")), "id_a")
        .join(gb.select(F.col("id").alias("id_b"), F.col("copies").alias("copies_b")), "id_b")
    )


def similar_pairs(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> DataFrame:
    """id_a, id_b, similarity of all pairs above the threshold. Equal vectors are compared once and
    the pairs of their copies follow by joins on the group."""
    ga, gb = _copies(a), _copies(b)
    pairs = vector_join.pairs_above(ga, gb, threshold)

    def members(df: DataFrame, groups: DataFrame, side: str) -> DataFrame:
        return df.join(groups.select("vector", F.col("id").alias(f"id_{side}")), "vector").select(
            f"id_{side}", F.col("id").alias(f"member_{side}")
        )

    return (
        pairs.join(members(a, ga, "a"), "id_a").join(members(b, gb, "b"), "id_b")
        .select(F.col("member_a").alias("id_a"), F.col("member_b").alias("id_b"), "similarity")
    )


def cards_for_nodes(nodes: DataFrame, cards: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k cards most similar to each node: node_label, card_id, similarity, rank. Nodes and cards carry
    (id, embedding_id); vectors are (id, vector)."""
    by_id = vectors.select(F.col("id").alias("embedding_id"), "vector")
    labelled = nodes.groupBy("label").agg(F.min_by("embedding_id", "id").alias("embedding_id"), F.min("id").alias("id"))
    queries = labelled.join(by_id, "embedding_id").select("id", "vector")
    targets = cards.select("id", "embedding_id").join(by_id, "embedding_id").select("id", "vector")
    best = vector_join.top_k(queries, targets, k)
    return best.join(labelled.select(F.col("id").alias("id_a"), F.col("label").alias("node_label")), "id_a").select(
        "node_label", F.col("id_b").alias("card_id"), "similarity", "rank"
    )


def nodes_for_cards(cards: DataFrame, nodes: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k concepts, topics or entities most similar to each card: card_id, node_id, label, node_type, similarity, rank."""
    by_id = vectors.select(F.col("id").alias("embedding_id"), "vector")
    linkable = nodes.filter(F.col("node_type").isin(*LINKABLE))
    queries = cards.select("id", "embedding_id").join(by_id, "embedding_id").select("id", "vector")
    targets = linkable.select("id", "embedding_id").join(by_id, "embedding_id").select("id", "vector")
    best = vector_join.top_k(queries, targets, k)
    return best.join(linkable.select(F.col("id").alias("id_b"), "label", "node_type"), "id_b").select(
        F.col("id_a").alias("card_id"), F.col("id_b").alias("node_id"), "label", "node_type", "similarity", "rank"
    )


def cluster_cards(vectors: DataFrame, k: int = 5, restarts: int = 10, seed: int = 42) -> DataFrame:
    """K-means cluster of every card, the best of several seeded starts; k shrinks to the number of cards."""
    few = vectors.select("id").limit(k).count()
    if few == 0:
        return vectors.select("id").withColumn("cluster", F.lit(None).cast("int"))
    data = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features")).persist()
    try:
        fits = [KMeans(k=max(1, min(k, few)), seed=seed + i, maxIter=50).fit(data) for i in range(restarts)]
        best = min(fits, key=lambda m: m.summary.trainingCost)
        return best.transform(vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))).select(
            "id", F.col("prediction").alias("cluster")
        )
    finally:
        data.unpersist()


def link_stats(groups: DataFrame) -> DataFrame:
    """Links, cards, nodes and mean similarity over the qualifying pairs of ``similar_groups``. Copies
    count through their group sizes, so the pairs themselves are never expanded."""
    links = F.col("copies_a") * F.col("copies_b")
    zero = F.lit(0).cast("bigint")

    def row(df: DataFrame, **parts) -> DataFrame:
        return df.select(*[
            parts.get(name, F.lit(0.0) if name == "weighted" else zero).alias(name) for name in ("links", "weighted", "cards", "nodes")
        ])

    per_card = groups.groupBy("id_a").agg(F.first("copies_a").alias("n"))
    per_node = groups.groupBy("id_b").agg(F.first("copies_b").alias("n"))
    parts = (
        row(groups, links=links, weighted=F.col("similarity") * links)
        .unionByName(row(per_card, cards=F.col("n")))
        .unionByName(row(per_node, nodes=F.col("n")))
    )
    totals = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("links", "weighted", "cards", "nodes")])
    mean = F.when(F.col("links") > 0, F.col("weighted") / F.col("links")).otherwise(0.0)
    return totals.select("links", "cards", "nodes", mean.alias("avg_similarity"))
