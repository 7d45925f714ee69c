"""Per-group pages. A rank bounded by a literal lets Spark prune each group before its shuffle,
so a hot group never reaches one task whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRUNED = 1000      # Spark prunes groups up to this rank (spark.sql.optimizer.windowGroupLimitThreshold)
PARTS = 64


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, offset: int = 0, rank: str = "rank") -> DataFrame:
    """Rows offset+1 .. offset+n of every group, with their position in ``rank``.

    For deep pages, which Spark doesn't prune, each group is first cut into parts by a hash of its rows, and each part
    keeps its own first offset + n rows: no task sorts a whole hot group.
    """
    last = offset + n
    if last > PRUNED:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        inner = Window.partitionBy(*by, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_near", F.row_number().over(inner)).filter(F.col("_near") <= last).drop("_part", "_near")
    window = Window.partitionBy(*by).orderBy(*order)
    page = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= last)
    return page.filter(F.col(rank) > offset) if offset else page
