"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, lookup distances, exact rerank.

The codebooks are fitted on a bounded sample; every row is indexed. Probes and lookup distances only rule out what
geometry rules out, so the links found are all those of an exhaustive comparison:

* a vector within r of x lies in a list whose centre c' has |x-c'|^2 - |x-c|^2 <= 2 r |c-c'|, c being the centre
  nearest to x, as the vector is on the side of c' of the plane halfway between both;
* with y = centre + decoded residual + error, |x - y| >= |x - decoded y| - |error|, and |error| is stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from studyspark.llm.components import components
from studyspark.session import written

#: Rows the codebooks are fitted on (those of smallest hash), subspaces and codewords per subspace.
SAMPLE_ROWS, SUBSPACES, CODEWORDS = 8192, 8, 32
#: Inverted lists: a quarter of the root of the rows, within these bounds (the sample can't tell more apart).
LEAST_LISTS, MOST_LISTS = 16, 1024
#: Vectors of one list that are compared together; a longer list is cut into blocks.
BLOCK_ROWS = 1024


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres by Lloyd's rounds; fewer than ``k`` where there are fewer rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = (np.square(centres).sum(1) - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class Quantiser:
    """Coarse centres and residual codebooks for one number of dimensions."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codewords: int) -> None:
        self.dim = sample.shape[1]
        self.centres = _kmeans(sample, lists, 1)
        residuals = sample - self.centres[self.nearest(sample)]
        self.cuts = np.linspace(0, self.dim, min(subspaces, self.dim) + 1).astype(int)
        self.books = [_kmeans(residuals[:, a:b], codewords, 2 + a) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(np.square(x).sum(1)[:, None] + np.square(self.centres).sum(1) - 2 * x @ self.centres.T, 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(1)

    def encode(self, x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the length of each vector's coding error."""
        rest = x - self.centres[cells]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:])):
            part = rest[:, a:b]
            codes[:, m] = (np.square(book).sum(1) - 2 * part @ book.T).argmin(1)
            error += np.square(part - book[codes[:, m]]).sum(1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, cells: np.ndarray, radius: float) -> np.ndarray:
        """For each vector, which lists can hold a vector within ``radius``: its own is among them."""
        d = self.distances(x)
        between = np.sqrt(np.maximum(np.square(self.centres[:, None] - self.centres[None]).sum(2), 0))
        return d - d[np.arange(len(x)), cells][:, None] <= 2 * radius * between[cells] + 1e-9

    def lookup(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances from whole vectors to the codes of one list: sums of table entries."""
        rest = x - self.centres[cell]
        total = np.zeros((len(x), len(codes)))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:])):
            part = rest[:, a:b]
            table = np.square(part).sum(1)[:, None] + np.square(book).sum(1) - 2 * part @ book.T
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def _usable() -> Column:
    """Whether a row (key, label, v) can link at all."""
    numbers = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    return F.coalesce(F.col("v").isNotNull() & F.col("label").isNotNull() & F.col("key").isNotNull() & numbers, F.lit(False))


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(key, label, dim, unit, digest) of the rows (key, label, v) that can link at all, scaled to length 1 in double
    precision. Copies of one vector and label have one digest, of 128 bits."""
    x = F.col("v")
    rows = rows.where(_usable())
    # Scaled by the largest component first, so that no square overflows or vanishes.
    big = F.aggregate(x, F.lit(0.0), lambda m, e: F.greatest(m, F.abs(e)))
    rows = rows.withColumn("v", F.transform(x, lambda e: e / big))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
    digest = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform(x, lambda e: (e + 0.0).cast("string"))), 256)
    return rows.select("key", "label", F.size("v").alias("dim"), F.transform(x, lambda e: e / norm).alias("unit"), F.substring(digest, 1, 32).alias("digest"))


def fit_quantisers(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS, lists: int = LEAST_LISTS, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> dict[int, Quantiser]:
    """A quantiser per number of dimensions, fitted on at most ``sample_rows`` vectors in all, those of smallest digest."""
    sample = vectors.select("dim", "unit", "rep").orderBy("rep").limit(sample_rows).select("dim", "unit").collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(row["dim"], []).append(row["unit"])
    return {dim: Quantiser(np.array(rows), lists, subspaces, codewords) for dim, rows in by_dim.items()}


def _frame(unit: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(u, np.float64) for u in unit])


def _index(vectors: DataFrame, quantisers: dict[int, Quantiser], radius: float) -> DataFrame:
    """(rep, n, label, dim, unit, cell, codes, error, probes) per vector. A number of dimensions that the sample lacks has one list."""
    schema = StructType([*vectors.schema, StructField("cell", IntegerType()), StructField("codes", BinaryType()), StructField("error", DoubleType()), StructField("probes", ArrayType(IntegerType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                q = quantisers.get(int(dim))
                if q is None:
                    yield part.assign(cell=0, codes=b"", error=0.0, probes=[[0]] * len(part))
                    continue
                for at in range(0, len(part), 4096):
                    piece = part.iloc[at:at + 4096]
                    x = _frame(piece["unit"])
                    cells = q.nearest(x)
                    codes, error = q.encode(x, cells)
                    probes = q.probes(x, cells, radius)
                    yield piece.assign(cell=cells, codes=[c.tobytes() for c in codes], error=error, probes=[np.flatnonzero(p).astype(np.int32) for p in probes])

    return vectors.mapInPandas(run, schema)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node that each of ``n`` nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if np.array_equal(low, high):
            return root
        np.minimum.at(root, high, low)
        while not np.array_equal(root, further := root[root]):
            root = further


def _compare(index: DataFrame, quantisers: dict[int, Quantiser], least: float, block_rows: int) -> DataFrame:
    """(rep, links, other) for every vector and block of a list it probes: how many rows it links with there. ``other``
    is the least vector it is connected with in the block, so that these edges hold all connections."""
    def block(blocks: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")

    homes_n = index.groupBy("label", "dim", "cell").agg(F.count("*").alias("rows"))
    asks_n = index.select("label", "dim", F.explode("probes").alias("cell")).groupBy("label", "dim", "cell").agg(F.count("*").alias("asks"))
    blocks = homes_n.join(asks_n, ["label", "dim", "cell"]).select(
        F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("c"),
        F.ceil(F.col("rows") / block_rows).cast("int").alias("hb"), F.ceil(F.col("asks") / block_rows).cast("int").alias("ab"))
    here = (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c"))
    homes = index.join(blocks, here).select("label", "dim", "cell", block("hb").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("ab"),
                                            F.lit(True).alias("home"), "rep", "n", "unit", "codes", "error")
    asks = index.select("label", "dim", F.explode("probes").alias("cell"), "rep", "n", "unit").join(blocks, here) \
        .select("label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("hb"), block("ab").alias("ab"), F.lit(False).alias("home"), "rep", "n", "unit",
                F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))
    key_type = index.schema["rep"].dataType
    schema = StructType([StructField("rep", key_type), StructField("links", LongType()), StructField("other", key_type)])
    radius = float(np.sqrt(max(2 - 2 * least, 0))) + 1e-6

    def run(group: pd.DataFrame) -> pd.DataFrame:
        home, ask = group[group["home"]], group[~group["home"]]
        if home.empty or ask.empty:
            return pd.DataFrame({"rep": [], "links": [], "other": []}).astype({"rep": group["rep"].dtype, "links": "int64", "other": group["rep"].dtype})
        q = quantisers.get(int(group["dim"].iloc[0]))
        nodes, where = np.unique(np.concatenate([home["rep"], ask["rep"]]), return_inverse=True)
        names, asking = where[:len(home)], where[len(home):]
        y, weights = _frame(home["unit"]), home["n"].to_numpy()
        codes = np.frombuffer(b"".join(home["codes"]), np.uint8).reshape(len(home), -1) if q else None
        reach = radius + home["error"].to_numpy()
        links, first, second = np.zeros(len(nodes), np.int64), [], []
        for at in range(0, len(ask), 256):
            x, own = _frame(ask["unit"].iloc[at:at + 256]), asking[at:at + 256]
            near = q.lookup(x, int(group["cell"].iloc[0]), codes) <= reach if q else np.ones((len(x), len(y)), bool)
            rows, columns = np.nonzero(near)
            for k in range(0, len(rows), 1 << 15):
                r, c = rows[k:k + (1 << 15)], columns[k:k + (1 << 15)]
                hit = (np.einsum("ij,ij->i", x[r], y[c]) >= least) & (own[r] != names[c])
                r, c = r[hit], c[hit]
                np.add.at(links, own[r], weights[c])
                first.append(own[r])
                second.append(names[c])
        root = _roots(np.concatenate(first or [names[:0]]), np.concatenate(second or [names[:0]]), len(nodes))
        told = np.flatnonzero((links > 0) | (root != np.arange(len(nodes))))
        return pd.DataFrame({"rep": nodes[told], "links": links[told], "other": nodes[root[told]]})

    return homes.unionByName(asks).groupBy("label", "dim", "cell", "hb", "ab").applyInPandas(run, schema)


def near_duplicates(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                    least: float = 0.98, block_rows: int = BLOCK_ROWS, lists: int | None = None) -> DataFrame:
    """Per row: the id, n_links, component_id, kept. Rows link when their labels are equal and not null, their vectors
    are as long and the cosine is ``least`` or more. A vector that is null, empty, zero, or holds null or a non-finite
    number links with nothing. Rows with one vector and label are compared once and counted as often as they come; rows of
    one id with different vectors are told apart, and each links by its own. Of each component the rows with the smallest
    id are kept. A row without an id links with nothing and is kept. Extra columns are left out.
    """
    rows = embeddings.select(F.col(id_column).alias("key"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    usable = written(usable_vectors(rows), "usable")
    vectors = written(usable.groupBy(F.col("digest").alias("rep")).agg(F.min("key").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit")), "vectors")
    lists = lists or int(min(MOST_LISTS, max(LEAST_LISTS, vectors.count() ** 0.5 / 4)))
    quantisers = fit_quantisers(vectors, lists=lists)
    index = written(_index(vectors.drop("least"), quantisers, float(np.sqrt(max(2 - 2 * least, 0))) + 1e-6), "index")
    found = written(_compare(index, quantisers, least, block_rows), "found")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "r")
    label = components(found.where("rep <> other"), "rep", "other")
    table = written(vectors.select("rep", "least", "n").join(linked, F.col("rep") == F.col("r"), "left").join(label, F.col("rep") == F.col("node"), "left")
                    .select("rep", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "classes")
    smallest = table.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    table = table.join(smallest, F.col("component") == F.col("c")).select("rep", "links", "component_id")
    known = usable.select("key", "digest").join(table, F.col("digest") == F.col("rep")).select("key", F.col("links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(~_usable()).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return known.unionByName(alone).select(F.col("key").alias(id_column), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("key"), F.lit(True)).alias("kept"))
