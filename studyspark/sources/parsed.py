"""Parsed note content: JSON in, one table per kind of item out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.schemas import PARSED_CONTENT


def _filled(*names: str | Column) -> Column:
    """The first of the alternate keys that holds something."""
    return F.coalesce(*[F.nullif(F.col(n) if isinstance(n, str) else n, F.lit("")) for n in names])


def parse_content(df: DataFrame, column: str = "parsed_content") -> DataFrame:
    return df.withColumn("parsed", F.from_json(F.col(column), PARSED_CONTENT)).drop(column)


def explode_parsed(df: DataFrame) -> dict[str, DataFrame]:
    """Tables topics, subtopics, formulas, concepts and questions of (note_id, parsed_content), or of notes that
    ``parse_content`` has parsed already."""
    parsed = df if "parsed" in df.columns else parse_content(df.select("note_id", "parsed_content"))

    def items(array: str, pos: str) -> DataFrame:
        return parsed.select("note_id", F.posexplode(f"parsed.{array}").alias(pos, "x"))

    topics = items("topics", "topic_no").select(
        "note_id", "topic_no", F.coalesce(_filled("x.title", "x.name"), F.lit("topic")).alias("name"),
        F.col("x.description").alias("description"), F.col("x.subtopics").alias("subtopics"),
    )
    return {
        "topics": topics.drop("subtopics"),
        "subtopics": topics.select("note_id", "topic_no", F.col("name").alias("topic"), F.posexplode("subtopics").alias("subtopic_no", "s")).select(
            "note_id", "topic_no", "topic", "subtopic_no", F.coalesce(_filled("s.title", "s.name"), F.lit("subtopic")).alias("name"),
            F.col("s.content").alias("content"), F.col("s.key_points").alias("key_points"),
        ),
        "formulas": items("formulas", "pos").select(
            "note_id", "pos", F.coalesce(_filled("x.latex", "x.expression"), F.lit("formula")).alias("latex"),
            F.col("x.description").alias("description"), F.col("x.variables").alias("variables"),
        ),
        "concepts": items("key_concepts", "pos").select(
            "note_id", "pos", F.coalesce(_filled("x.name", "x.label"), F.lit("concept")).alias("name"),
            F.col("x.definition").alias("definition"), F.col("x.examples").alias("examples"),
        ),
        "questions": items("questions", "pos").select(
            "note_id", "pos", F.coalesce(_filled("x.question", "x.q"), F.lit("")).alias("question"),
            F.coalesce(_filled("x.answer", "x.a"), F.lit("")).alias("answer"),
            F.coalesce(_filled("x.difficulty", "x.difficulty_label"), F.lit("")).alias("difficulty"),
            _filled("x.context", "x.topic").alias("context"),
        ),
    }


def note_arrays(parsed: DataFrame) -> DataFrame:
    """note_id, topics (name, text with that of the subtopics) and formulas (latex, description) of parsed notes, as arrays of
    their row, by the names that ``explode_parsed`` gives."""
    contents = F.transform("parsed.topics", lambda x: F.struct(
        F.coalesce(_filled(x["title"], x["name"]), F.lit("topic")).alias("name"),
        F.concat_ws(" ", F.coalesce(x["description"], F.lit("")), F.when(
            F.size(x["subtopics"]) > 0, F.array_join(F.transform(x["subtopics"], lambda s: F.coalesce(s["content"], F.lit(""))), " "))).alias("text")))
    formulas = F.transform("parsed.formulas", lambda x: F.struct(
        F.coalesce(_filled(x["latex"], x["expression"]), F.lit("formula")).alias("latex"), F.coalesce(x["description"], F.lit("")).alias("description")))
    return parsed.select("note_id", contents.alias("topics"), formulas.alias("formulas"))
