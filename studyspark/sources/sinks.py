"""Writers: graph and deck exports, appends that skip known keys, and merged note results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed_properties(column: str = "properties") -> Column:
    """Free-form JSON properties as a map; broken or missing JSON gives an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(F.col(column), "map<string,string>", {"mode": "PERMISSIVE"}), empty)


def graph_json(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exported shape: nodes (id, node_type, label, properties) and edges (source, target, type, weight)."""
    return (
        nodes.select("id", "node_type", "label", parsed_properties().alias("properties")),
        edges.select("source", "target", "type", "weight"),
    )


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "error") -> None:
    """Node and edge JSON lines below ``path``, written in parallel."""
    n, e = graph_json(nodes, edges)
    n.write.mode(mode).json(f"{path}/nodes")
    e.write.mode(mode).json(f"{path}/edges")


def deck_summary(cards: DataFrame) -> DataFrame:
    """One row: total cards, and maps of counts by difficulty and by source type."""
    def counts(column: str) -> DataFrame:
        pairs = cards.groupBy(F.col(column).cast("string").alias("k")).agg(F.count("*").alias("n"))
        return pairs.select(F.lit(column).alias("kind"), "k", "n")

    entry = F.struct("k", "n")
    rows = counts("difficulty").unionByName(counts("source_type"))
    return rows.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "difficulty", F.col("n"))), F.lit(0)).alias("total_flashcards"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "difficulty", entry)))).alias("by_difficulty"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "source_type", entry)))).alias("by_source_type"),
    )


def write_deck(cards: DataFrame, path: str, mode: str = "error") -> None:
    """Cards and their summary as JSON lines below ``path``."""
    cards.write.mode(mode).json(f"{path}/flashcards")
    deck_summary(cards).write.mode(mode).json(f"{path}/metadata")


def append_new(target: DataFrame, batch: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of ``batch`` to append: keys the target lacks, each key once (the first by ``order``)."""
    fresh = batch.join(target.select(*key), key, "left_anti")
    if order is None:
        return fresh.dropDuplicates(key)
    first = fresh.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in batch.columns if c not in key and c not in order])).alias("_r"))
    return first.select(*key, "_r.*").select(*batch.columns)


def merge_results(notes: DataFrame, results: DataFrame, key: str = "note_id") -> DataFrame:
    """Notes with the columns of their result row set; a null result keeps the old value. A result carries the columns
    it wants to set under the same names."""
    updates = [c for c in results.columns if c != key]
    incoming = results.select(key, *[F.col(c).alias(f"_new_{c}") for c in updates])
    joined = notes.join(incoming, key, "left")
    return joined.select(*[
        F.coalesce(f"_new_{c}", c).alias(c) if c in updates else F.col(c) for c in notes.columns
    ])
