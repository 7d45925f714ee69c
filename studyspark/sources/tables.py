"""Readers: text corpora, entity tables, service logs and review event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.schemas import LOG_EVENTS, STUDY_TABLES, TABLES

FORMATS = ("plain", "markdown", "pdf")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names=tuple(TABLES)) -> dict[str, DataFrame]:
    """Every named table with its fixed schema; nothing is inferred."""
    return {name: read_table(spark, folder, name) for name in names}


def read_study_tables(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The application's own tables, one sub-folder or file per table."""
    return {
        name: spark.read.format(fmt).schema(schema).load(f"{folder}/{name}.{fmt}")
        for name, schema in STUDY_TABLES.items()
    }


def read_study_tables_jdbc(spark: SparkSession, url: str, partition: dict[str, dict] | None = None, **options) -> dict[str, DataFrame]:
    """The same tables over JDBC. ``partition`` names a split column and bounds per table, so
    that a large table is read by many tasks."""
    out = {}
    for name, schema in STUDY_TABLES.items():
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for key, value in {**options, **(partition or {}).get(name, {})}.items():
            reader = reader.option(key, value)
        columns = [field.split()[0] for field in schema.split(", ")]
        out[name] = reader.load().select(*columns)
    return out


def read_corpus(spark: SparkSession, path: str, fmt: str = "plain") -> DataFrame:
    """One row per text file: doc_id (the file's path), text, fmt."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown corpus format: {fmt}")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"), F.lit(fmt).alias("fmt"))
    )


def tag_format(documents: DataFrame) -> DataFrame:
    """Tag documents that are already rows. Markdown shows a heading, fence or link; text taken
    from a PDF shows a ``Page n`` mark or a line broken at a hyphen."""
    markdown = F.col("text").rlike(r"(?m)^(#+ |```)|\[[^\]]+\]\([^)]+\)")
    pdf = F.col("text").rlike(r"Page [0-9]+|[A-Za-z]-\n[A-Za-z]")
    return documents.withColumn("fmt", F.when(markdown, "markdown").when(pdf, "pdf").otherwise("plain"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """JSON log lines: event, ts and the raw line, whose fields ``log_events`` parses per event name."""
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.message").alias("event"),
        F.get_json_object("value", "$.timestamp").try_cast("timestamp").alias("ts"),
        F.col("value").alias("line"),
    )


def log_events(logs: DataFrame, event: str) -> DataFrame:
    """The lines of one event name, parsed with that event's schema."""
    fields = F.from_json("line", LOG_EVENTS[event])
    return logs.filter(F.col("event") == event).select("ts", fields.alias("f")).select("ts", "f.*")


def read_reviews_stream(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Append-only review events as a stream of (user_id, card_id, review_id, quality, time_spent, reviewed_at)."""
    schema = schema or "user_id BIGINT, card_id BIGINT, review_id BIGINT, quality INT, time_spent BIGINT, reviewed_at TIMESTAMP"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.format(fmt).load(path)
