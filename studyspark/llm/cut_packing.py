"""Concatenate and cut: documents laid end to end, cut into windows of one length.

Two passes of prefix sums give every document its global position: the tokens before it in its task, written
with its ids, and the tokens of all earlier tasks. No row crosses the network to be packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 2048


def cut(tokens: DataFrame, id_column: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Boundary records: one row per piece of a document in a window.

    ``tokens`` is a written table of ``tokenize``. Columns: the id, start (the document's ids before the piece),
    length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset (in the window). Only the last window is
    short. Repeated rows are packed as often as they come; an empty table gives no piece.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the tokenizing job, so its size follows the number of tasks, not the rows.
    bases = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total")) \
        .select(F.col("part").alias("base_part"), F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(bases), F.col("part") == F.col("base_part")) \
        .select(F.col(id_column).alias("key"), "ids", "n_tokens", (F.col("base") + F.col("before")).alias("at"))
    first, end = f"greatest(at, s * {window})", f"least(at + n_tokens, (s + 1) * {window})"
    piece = f"""transform(sequence(at div {window}, (at + n_tokens - 1) div {window}), s -> struct(
        {first} - at AS start, {end} - {first} AS length,
        substring(ids, cast(({first} - at) * 4 + 1 AS int), cast(({end} - {first}) * 4 AS int)) AS ids,
        s AS sequence_id, {first} - s * {window} AS offset))"""
    pieces = placed.select("key", F.col("n_tokens").alias("doc_tokens"), F.explode(F.expr(piece)).alias("p"))
    return pieces.select(F.col("key").alias(id_column), "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def windows(pieces: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Whole windows: sequence_id, ids (all pieces joined), and boundaries, an array of (offset, length, id, start).
    A group holds at most one window's tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", F.col(id_column), "start", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, X'', (joined, p) -> concat(joined, p.ids))").alias("ids"),
        F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p[id_column].alias(id_column), p["start"].alias("start"))).alias("boundaries"))
