"""The test tables seen as study data. Every view exists twice: as a DataFrame and as SQL text
for the value check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.sources.tables import read_table

AS_OF = "1998-09-02"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


SQL: dict[str, str] = {}

SQL["users"] = """
  SELECT c_custkey AS user_id, c_name AS email, c_nationkey AS nation,
         TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
         c_acctbal >= 0 AS is_active, c_mktsegment <> 'BUILDING' AS email_verified
  FROM customer"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("email"),
        F.col("c_nationkey").alias("nation"),
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 365 AS INT))").alias("created_at"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        (F.col("c_mktsegment") != "BUILDING").alias("email_verified"),
    )


SQL["notes"] = """
  SELECT o_orderkey AS note_id, o_custkey AS user_id,
         CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority AS subject_id, o_orderpriority AS name,
         o_orderstatus AS status, o_orderdate AS created_at,
         o_orderpriority || ' note ' || CAST(o_orderkey AS VARCHAR) AS title
  FROM orders"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("note_id"),
        F.col("o_custkey").alias("user_id"),
        F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("subject_id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.concat("o_orderpriority", F.lit(" note "), F.col("o_orderkey").cast("string")).alias("title"),
    )


SQL["subjects"] = """
  SELECT subject_id, user_id, name, min(created_at) AS created_at FROM notes GROUP BY ALL"""


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).groupBy("subject_id", "user_id", "name").agg(F.min("created_at").alias("created_at"))


SQL["cards"] = """
  SELECT l_orderkey * 10 + l_linenumber AS card_id, l_orderkey AS note_id, o_custkey AS user_id,
         CAST(l_shipdate AS DATE) AS next_review_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def cards(spark: SparkSession, sf: str) -> DataFrame:
    owners = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("user_id"))
    lines = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("card_id"),
        F.col("l_orderkey").alias("note_id"),
        F.to_date("l_shipdate").alias("next_review_date"),
    )
    return lines.join(owners, "note_id")


SQL["reviews"] = """
  SELECT event_id AS review_id, user_id, user_id * 10 + event_id % 10 AS card_id,
         CAST(floor(value) AS BIGINT) % 6 AS quality, CAST(floor(value) AS BIGINT) AS time_spent,
         ts AS reviewed_at
  FROM events"""


def as_reviews(events: DataFrame) -> DataFrame:
    """Review events out of an events table, batch or stream."""
    return events.select(
        F.col("event_id").alias("review_id"),
        "user_id",
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("card_id"),
        (F.floor("value") % 6).cast("int").alias("quality"),
        F.floor("value").cast("bigint").alias("time_spent"),
        F.col("ts").alias("reviewed_at"),
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return as_reviews(read_table(spark, sf, "events"))


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL text with the named views, in the given order, as common table expressions."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ", ".join(f"{name} AS ({SQL[name]})" for name in names.split()) + body
