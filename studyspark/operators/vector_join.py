"""Exact similarity joins over vectors.

Both sides are cut into cells around pivot vectors, at every size alike. A vector is compared only with the
cells its search radius reaches, which the triangle inequality decides without losing a pair. Cells are cut
further into blocks of bounded size, so neither a crowded cell nor a group of equal vectors ever meets in one
task: a task holds two blocks and the products of a strip of one with the other. A block is as large as memory allows, since
each block is sent to all blocks it meets. Vectors travel as they were given; all arithmetic is in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.operators.paging import top_n
from studyspark.session import cut_lineage

BLOCK_BYTES = 8_000_000           # of one side of a block product, as doubles
BLOCK_ROWS = 16_384               # and its most rows
STRIP = 256                       # rows of it that meet the other side at once
MAX_PIVOTS = 512
SLACK = 1e-7


def _unit(vectors) -> np.ndarray:
    matrix = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    if matrix.size == 0:
        return matrix.reshape(0, 0)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest similarities, ties to the smallest id, never more than k."""
    if len(sims) > k:
        kth = np.partition(sims, len(sims) - k)[len(sims) - k]
        places = np.flatnonzero(sims >= kth)
    else:
        places = np.arange(len(sims))
    return places[np.lexsort((ids[places], -sims[places]))[:k]]


def _matches(left_ids, left, right_ids, right, threshold: float | None, k: int | None, by_left: bool = True) -> pd.DataFrame:
    """Pairs of one block: all above the threshold, or the k best per row of the keyed side."""
    if by_left and len(left) > STRIP:
        return pd.concat([_matches(left_ids[i:i + STRIP], left[i:i + STRIP], right_ids, right, threshold, k) for i in range(0, len(left), STRIP)], ignore_index=True)
    sims = np.clip(left @ right.T, -1.0, 1.0)
    if threshold is not None:
        i, j = np.nonzero(sims > threshold)
    else:
        grid = sims if by_left else sims.T
        ids = right_ids if by_left else left_ids
        picked = [_best(ids, row, k) for row in grid]
        outer = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
        inner = np.concatenate(picked) if picked else np.array([], dtype=int)
        i, j = (outer, inner) if by_left else (inner, outer)
    return pd.DataFrame({"id_a": left_ids[i], "id_b": right_ids[j], "similarity": sims[i, j]})


def _schema(a: DataFrame, b: DataFrame) -> str:
    kind = {d.schema["id"].dataType.simpleString() for d in (a, b)}
    if len(kind) != 1:
        raise ValueError("both sides need the same id type")
    t = kind.pop()
    return f"id_a {t}, id_b {t}, similarity double"


def _pivots(df: DataFrame, rows: int) -> np.ndarray:
    count = max(1, min(MAX_PIVOTS, int(math.sqrt(rows) / 8)))
    picked = df.orderBy(F.xxhash64("id"), "id").limit(count).select("vector").collect()
    return np.unique(_unit([r[0] for r in picked]), axis=0)


def _distances(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (matrix ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * matrix @ pivots.T))


def _kind(df: DataFrame, name: str) -> str:
    """A column of ``df`` with its type."""
    return f"{name} {df.schema[name].dataType.simpleString()}"


def _home_cells(df: DataFrame, pivots) -> DataFrame:
    """Nearest pivot of every vector and the distance to it, beside the columns of ``df``."""
    schema = ", ".join(_kind(df, c) for c in df.columns) + ", cell int, reach double"

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_unit(pdf["vector"]), pivots.value)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype("int32"), reach=d[np.arange(len(d)), cell])

    return df.mapInPandas(assign, schema)


def _reached_cells(df: DataFrame, pivots, radius: np.ndarray) -> DataFrame:
    """One row per cell a vector's search radius ``eps`` can reach."""
    schema = f"{_kind(df, 'id')}, {_kind(df, 'vector')}, cells array<int>"
    gaps = _distances(pivots.value, pivots.value)

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            d = _distances(_unit(pdf["vector"]), pivots.value)
            near = d.argmin(1)
            least = d[np.arange(len(d)), near]
            eps = pdf["eps"].to_numpy()[:, None] + SLACK
            apart = gaps[near]
            # Distance to the plane between the nearest pivot and each other pivot.
            plane = np.divide(d ** 2 - least[:, None] ** 2, 2 * apart, out=np.zeros_like(d), where=apart > 0)
            hit = (plane <= eps) & (d <= radius[None, :] + eps)
            yield pd.DataFrame({
                "id": pdf["id"], "vector": pdf["vector"], "cells": [np.flatnonzero(row).astype("int32") for row in hit],
            })

    found = df.select("id", "vector", "eps").mapInPandas(assign, schema)
    return found.select("id", "vector", F.explode("cells").alias("cell"))


def _lookup(values: list[int], cell: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(x)) for x in values]), cell + 1)


def _block_product(probe: DataFrame, home: DataFrame, home_counts: list[int], cells: int, threshold, k, schema: str, dim: int, carry: str | None = None) -> DataFrame:
    """Every probe block against every home block of the same cell, each pair in its own group."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, dim))))
    probe_counts = [0] * cells
    for row in probe.groupBy("cell").count().collect():     # at most MAX_PIVOTS rows
        probe_counts[row["cell"]] = row["count"]
    home_blocks = [max(1, -(-n // rows)) for n in home_counts]
    probe_blocks = [max(1, -(-n // rows)) for n in probe_counts]

    def keyed(df: DataFrame, own: list[int], other: list[int], own_key: str, other_key: str) -> DataFrame:
        return df.select(
            *[c for c in df.columns if c != "reach"],
            F.pmod(F.xxhash64("id"), _lookup(own, F.col("cell"))).cast("int").alias(own_key),
            F.explode(F.sequence(F.lit(0), _lookup(other, F.col("cell")) - 1)).alias(other_key),
        )

    left = keyed(probe, probe_blocks, home_blocks, "pb", "hb").groupBy("cell", "hb", "pb")
    right = keyed(home, home_blocks, probe_blocks, "hb", "pb").groupBy("cell", "hb", "pb")

    def product(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if not len(lhs) or not len(rhs):
            return pd.DataFrame({"id_a": lhs["id"][:0], "id_b": rhs["id"][:0], "similarity": np.array([], dtype=float)} | ({carry: rhs[carry][:0]} if carry else {}))
        if not carry:
            return _matches(lhs["id"].to_numpy(), _unit(lhs["vector"]), rhs["id"].to_numpy(), _unit(rhs["vector"]), threshold, k)
        found = _matches(lhs["id"].to_numpy(), _unit(lhs["vector"]), np.arange(len(rhs)), _unit(rhs["vector"]), threshold, k)
        at = found["id_b"].to_numpy()
        return found.assign(**{"id_b": rhs["id"].to_numpy()[at], carry: rhs[carry].to_numpy()[at]})

    return left.cogroup(right).applyInPandas(product, schema)


def _cells(a: DataFrame, b: DataFrame):
    """Home cells of ``b``, and the pivots with each cell's size and radius."""
    sc = b.sparkSession.sparkContext
    pivots = sc.broadcast(_pivots(b, b.count()))
    cells = len(pivots.value)
    home = cut_lineage(_home_cells(b, pivots))
    counts, radius = [0] * cells, np.zeros(cells)
    for row in home.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("r")).collect():
        counts[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    return pivots, home, counts, radius


def _distance_of(similarity: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - 2 * similarity))


def pairs_above(a: DataFrame, b: DataFrame, threshold: float, carry: str | None = None) -> DataFrame:
    """id_a, id_b, similarity of all pairs with cosine above ``threshold``. Inputs are (id, vector). A column of ``b`` named by
    ``carry`` comes along, which saves a join of all pairs."""
    if threshold < 0:
        raise ValueError("the threshold must not be negative")
    a, b = a.select("id", "vector"), b.select("id", "vector", *([carry] if carry else []))
    schema = _schema(a, b) + (f", {_kind(b, carry)}" if carry else "")
    if b.isEmpty():
        return b.sparkSession.createDataFrame([], schema)
    pivots, home, counts, radius = _cells(a, b)
    probe = cut_lineage(_reached_cells(a.withColumn("eps", _distance_of(F.lit(threshold))), pivots, radius))
    return _block_product(probe, home, counts, len(counts), threshold, None, schema, pivots.value.shape[1], carry)


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """id_a (query), id_b, similarity, rank: the k most similar vectors of every query."""
    a, b = queries.select("id", "vector"), vectors.select("id", "vector")
    schema = _schema(a, b)
    if b.isEmpty():
        return b.sparkSession.createDataFrame([], schema + ", rank int")
    pivots, home, counts, radius = _cells(a, b)
    # First look only at the query's own cell. The k-th similarity found there bounds the radius
    # within which the true k best must lie.
    own = _home_cells(a, pivots).select("id", "vector", "cell")
    first = _block_product(own, home, counts, len(counts), None, k, schema, pivots.value.shape[1])
    bound = (
        top_n(first, ["id_a"], [F.desc("similarity"), F.col("id_b")], k)
        .groupBy("id_a").agg(F.count("*").alias("n"), F.min("similarity").alias("kth"))
    )
    eps = F.when(F.col("n") >= k, _distance_of(F.col("kth"))).otherwise(F.lit(2.0))
    limited = a.join(bound.withColumnRenamed("id_a", "id"), "id", "left").select(
        "id", "vector", F.coalesce(eps, F.lit(2.0)).alias("eps")
    )
    probe = cut_lineage(_reached_cells(limited, pivots, radius))
    found = _block_product(probe, home, counts, len(counts), None, k, schema, pivots.value.shape[1])
    return top_n(found, ["id_a"], [F.desc("similarity"), F.col("id_b")], k)
