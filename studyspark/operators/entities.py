"""Entities of chunks: mentions, filtering, typing, canonical forms and fuzzy merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.functions import mentions as m
from studyspark.functions.text import bind
from studyspark.operators.edit_join import leader_clusters, similar_within
from studyspark.session import cut_lineage


def mentions(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, pos, text, context: candidate mentions of every chunk."""
    return chunks.select(
        "doc_id", "chunk_no", F.col("topic").alias("context"), F.posexplode(m.mention_array(F.col("text"))).alias("pos", "text")
    )


def filter_terms(df: DataFrame) -> DataFrame:
    return df.filter(m.is_academic_term(F.col("text")))


def classify_entity(df: DataFrame) -> DataFrame:
    return df.withColumn("type", m.entity_type(F.col("text"), F.col("context")))


def normalize_entity(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", m.normal_form(F.col("text")))


def entity_rows(chunks: DataFrame) -> DataFrame:
    """The kept mentions with type and normal form, one row each."""
    return normalize_entity(classify_entity(filter_terms(mentions(chunks))))


def canonical(df: DataFrame) -> DataFrame:
    """norm, text, mentions, first: the surface form used most, then the longest, then the smallest;
    ``first`` is the place of the first mention and gives the order for merging."""
    forms = df.groupBy("norm", "text").agg(
        F.count("*").alias("_n"), F.min(F.struct("doc_id", "chunk_no", "pos")).alias("_first")
    )
    best = F.min_by("text", F.struct(-F.col("_n"), -F.length("text"), F.col("text")))
    return forms.groupBy("norm").agg(
        best.alias("text"), F.sum("_n").alias("mentions"), F.min("_first").alias("first")
    )


def entity_stats(df: DataFrame) -> DataFrame:
    """Mentions and distinct normal forms per type."""
    return df.groupBy("type").agg(F.count("*").alias("mentions"), F.count_distinct("norm").alias("unique_entities"))


def entity_array(text: Column, context: Column) -> Column:
    kept = F.filter(m.mention_array(text), lambda x: m.is_academic_term(x))
    return bind(m.names_entities(context), lambda named: F.transform(kept, lambda x: F.struct(
        x.alias("text"), m.entity_type(x, context, named).alias("type"), m.confidence(x).alias("confidence")
    )))


def attach_entities(chunks: DataFrame) -> DataFrame:
    """Chunks with their entities as an array. Built inside the row, so nothing is shuffled or joined."""
    return chunks.withColumn("entities", entity_array(F.col("text"), F.col("topic")))


def attach_mentions(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks with mentions that come from elsewhere (doc_id, chunk_no, pos, text, type, confidence);
    a chunk without one gets an empty array."""
    grouped = found.groupBy("doc_id", "chunk_no").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "text", "type", "confidence"))),
            lambda x: F.struct(x["text"].alias("text"), x["type"].alias("type"), x["confidence"].alias("confidence")),
        ).alias("entities")
    )
    empty = F.array().cast("array<struct<text:string,type:string,confidence:double>>")
    return chunks.join(grouped, ["doc_id", "chunk_no"], "left").withColumn("entities", F.coalesce("entities", empty))


def similar_forms(canonicals: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of different folded forms whose edit similarity exceeds the threshold, the smaller form first."""
    forms = canonicals.select(F.lower("text").alias("s")).distinct()
    return similar_within(forms, threshold)


def fuzzy_merge(canonicals: DataFrame, threshold: float = 0.8) -> DataFrame:
    """text, forms, mentions: canonical forms merged by edit similarity. A form joins the first earlier group
    leader it is similar to; the longest form of a group stands for it."""
    keyed = cut_lineage(canonicals.withColumn("s", F.lower("text")))
    items = keyed.groupBy("s").agg(F.min("first").alias("ord")).withColumn("lead", F.col("ord.doc_id"))
    groups = leader_clusters(items, threshold)
    return keyed.join(groups, "s").groupBy("leader").agg(
        F.min_by("text", F.struct(-F.length("text"), F.col("first"))).alias("text"),
        F.count("*").alias("forms"), F.sum("mentions").alias("mentions"),
    )
