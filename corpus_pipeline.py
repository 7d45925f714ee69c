"""The training-data pipeline over ``documents``: quality rules, near duplicates, personal data, packing.

Every stage works on all that its predecessor kept and is written as Parquet before the next one reads it. All but
the last return the columns of their input.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.llm import cut_packing, pii, quality, set_join, word_tokens
from studyspark.session import ship_package, written

#: The near-duplicate stage takes five words and a similarity of 0.8.
SHINGLE_WORDS, PERCENT = 5, 80
#: Decisions about up to so many documents are sent to every task (some 100 bytes each); more are joined by a shuffle.
SENT_ROWS = 300_000


def _key() -> Column:
    """A document's id with a hash of its text, so that rows of one id but different texts are told apart."""
    return F.struct("doc_id", F.xxhash64("text").alias("text_hash"))


def _join(docs: DataFrame, decisions: DataFrame, on: Column, how: str) -> DataFrame:
    return docs.join(F.broadcast(decisions) if decisions.count() <= SENT_ROWS else decisions, on, how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    ship_package(spark)
    judged = quality.judged(docs.select(_key().alias("key"), "lang", "source", "text"), id_column="key")
    rejected = written(judged.where("NOT kept").select(F.col("key").alias("_rejected")).distinct(), "rejected")
    return _join(docs, rejected, _key().eqNullSafe(F.col("_rejected")), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id; and all that link with nothing. Rows of one id
    with different texts are documents of their own, of which one group keeps the one with the smallest hash; of rows equal in
    both one stays. Rows without an id all stay."""
    ship_package(spark)
    named = docs.where("doc_id IS NOT NULL")
    repeated = written(named.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_repeated")), "repeated")
    unique = repeated.isEmpty()
    key = F.col("doc_id") if unique else F.when(F.col("doc_id").isNotNull(), _key())
    groups = set_join.near_duplicates(named.select(key.alias("doc_id"), "text"), n=SHINGLE_WORDS, percent=PERCENT)
    dropped = written(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("_dropped")).distinct(), "dropped")
    stays = _join(docs, dropped, key == F.col("_dropped"), "left_anti")
    if unique:
        return stays
    once = stays.join(repeated, F.col("doc_id") == F.col("_repeated"), "left_semi").dropDuplicates(["doc_id", "text"])
    return stays.join(repeated, F.col("doc_id") == F.col("_repeated"), "left_anti").unionByName(once)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind; n_chars is counted anew."""
    ship_package(spark)
    found = pii.find(docs.select(_key().alias("key"), "text"), id_column="key").where("size(spans) > 0")
    spans = written(found.select(F.col("key").alias("_key"), F.col("spans").alias("_spans")).dropDuplicates(["_key"]), "spans")

    @F.pandas_udf("string")
    def mask(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([pii.masked(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans)])

    # Only the texts that change pass through Python.
    same = _key().eqNullSafe(F.col("_key"))
    changed = _join(docs, spans, same, "inner").withColumn("_masked", mask("text", "_spans"))
    new = {"text": F.col("_masked"), "n_chars": F.length("_masked").cast(docs.schema["n_chars"].dataType)}
    return _join(docs, spans, same, "left_anti").unionByName(changed.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens, with their ids."""
    ship_package(spark)
    return cut_packing.cut(written(word_tokens.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), special=True), "tokens"))


STAGES = [("quality_rules", quality_rules), ("drop_near_duplicates", drop_near_duplicates), ("mask_personal_data", mask_personal_data), ("pack", pack)]

#: SQL can express no stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
