"""Quality rules: counts per text, and outliers by minimum covariance determinant per language and source.

The counts come from one pass over the texts. The robust estimates are concentration steps over all documents:
each step is two grouped aggregations that combine before the shuffle, so no group is ever held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from studyspark.llm.batches import bytes_of, mix, sliced, span_hashes, sums_by_row, window_hashes, word_bounds
from studyspark.session import written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_runs")
REPEAT_WORDS = 8
LEAST_WORDS, MOST_REPEATED = 20, 30

#: Squared Mahalanobis distance beyond which a document is an outlier: with six dimensions a normal text passes it once in 10^8.
CUT = 50.0
#: Share of a group that the estimate rests on, and the steps from each start.
KEPT_SHARE, STEPS = 0.75, 3
#: Groups of fewer documents are pooled per language, then over all documents.
GROUP_ROWS = 200
#: Least standard deviation of each transformed statistic, so that constant ones don't make every difference an outlier.
FLOORS = (0.08, 0.05, 0.08, 0.05, 0.06, 0.05)
#: Words of the prior that steady the shares of short texts.
PRIOR = 40.0
_SYMBOL, _CONT, _UPPER, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CONT[128:192] = True
_UPPER[65:91] = True
_MARK[[ord(c) for c in "!?"]] = True


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each whole text; null counts as a text without words."""
    data, offsets = bytes_of(column)
    starts, ends, rows = word_bounds(data, offsets)
    per_row = np.diff(rows)
    out = {"n_words": per_row, "n_symbols": sums_by_row(_SYMBOL[data], offsets), "n_upper": sums_by_row(_UPPER[data], offsets),
           "n_marks": sums_by_row(_MARK[data], offsets)}
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_CONT[data], out=chars[1:])
    out["word_chars"] = sums_by_row(chars[ends] - chars[starts], rows)
    owner = np.repeat(np.arange(len(per_row)), per_row)
    with np.errstate(over="ignore"):
        salt = mix(np.arange(len(per_row), dtype=np.uint64) + np.uint64(7))
        # Lines with a word: those that hold the first word after a line break or a text's begin.
        breaks = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.append(line_starts[1:], len(data))
        ended = np.zeros(len(data) + 1, bool)
        ended[breaks + 1] = True
        line_ends = line_ends - ended[line_ends]
        first = np.searchsorted(starts, line_starts)
        filled = (first < len(starts)) & (np.append(starts, len(data))[first] < line_ends)
        line_starts, line_ends = line_starts[filled], line_ends[filled]
        line_owner = np.searchsorted(offsets, line_starts, "right") - 1
        keys = np.unique(mix(span_hashes(data, line_starts, line_ends) ^ salt[line_owner]), return_index=True)[1]
        out["n_dup_lines"] = np.bincount(line_owner, minlength=len(per_row)) - np.bincount(line_owner[keys], minlength=len(per_row))
        # Words inside a window of eight that the same text has more than once.
        words = span_hashes(data, starts, ends)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        out["n_runs"] = sums_by_row(again, rows)
        windows = window_hashes(words, REPEAT_WORDS)
        whole = owner[:len(windows)] == owner[REPEAT_WORDS - 1:] if len(windows) else np.zeros(0, bool)
        keys = mix(windows ^ salt[owner[:len(windows)]])
        ordered = np.sort(keys[whole])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        covered = np.zeros(len(starts) + 1, np.int64)
        if len(twice):
            at = np.flatnonzero(whole & np.isin(keys, twice))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + REPEAT_WORDS, -1)
        out["n_repeat_words"] = sums_by_row(np.cumsum(covered[:-1]) > 0, rows)
    return out


def counts(documents: DataFrame, columns: tuple[str, ...] = ("doc_id", "lang", "source"), text_column: str = "text") -> DataFrame:
    """``columns`` and COUNTS per row."""
    rows = documents.select(*[F.col(c) for c in columns], F.col(text_column).cast("string").alias("_text"))
    schema = StructType([*rows.schema[:-1], *[StructField(c, LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "_text"):
            found = text_counts(pc.fill_null(batch.column("_text"), ""))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(found[c], pa.int64()) for c in COUNTS]], names=schema.names)

    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def vector() -> list[Column]:
    """Transformed statistics: word length, and the shares of symbols, repeated windows, capitals, exclamations and
    words equal to the word before, on a log or root scale and drawn towards an ordinary text in short texts."""
    n, letters = F.col("n_words") + PRIOR, F.col("word_chars") + 5 * PRIOR
    return [F.log((F.col("word_chars") + 5 * PRIOR) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n),
            F.sqrt(F.col("n_upper") / letters), F.sqrt(F.col("n_marks") / n), F.sqrt(F.col("n_runs") / n)]


P = len(FLOORS)
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _moments(x: list[Column]) -> list[Column]:
    return [F.count("*").cast("double").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)],
            *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in _PAIRS]]


def _fitted(moments: DataFrame) -> DataFrame:
    """Mean, inverse covariance (upper triangle) and log determinant from the sums of each group: a row per group and start."""
    keys = [f for f in moments.schema if f.name in ("grp", "start")]
    names = [*[f"m{i}" for i in range(P)], *[f"w{i}_{j}" for i, j in _PAIRS], "logdet"]
    schema = ", ".join([*[f"{k.name} {k.dataType.simpleString()}" for k in keys], *[f"{c} double" for c in names]])
    kept = [k.name for k in keys]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["n"].to_numpy()[:, None]
            mean = frame[[f"s{i}" for i in range(P)]].to_numpy() / n
            cov = np.empty((len(frame), P, P))
            for i, j in _PAIRS:
                cov[:, i, j] = cov[:, j, i] = frame[f"s{i}_{j}"].to_numpy() / n[:, 0] - mean[:, i] * mean[:, j]
            cov += np.diag(np.square(FLOORS))
            inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            yield pd.DataFrame({**{k: frame[k] for k in kept}, **{f"m{i}": mean[:, i] for i in range(P)},
                                **{f"w{i}_{j}": inverse[:, i, j] for i, j in _PAIRS}, "logdet": logdet})

    return moments.mapInPandas(run, schema)


def _distance(x: list[Column]) -> Column:
    d = [x[i] - F.col(f"m{i}") for i in range(P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + (1.0 if i == j else 2.0) * d[i] * d[j] * F.col(f"w{i}_{j}")
    return total


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with ``grp``: language and source if they have ``least`` rows, else the language, else all documents."""
    def of(*parts: str) -> Column:
        return F.to_json(F.struct(*[F.col(p) for p in parts]), {"ignoreNullFields": "false"})
    fine, coarse = of("lang", "source"), of("lang")
    sizes = rows.groupBy("lang", "source").count()
    per_language = sizes.where(F.col("count") < least).groupBy(F.col("lang").alias("l")).agg(F.sum("count").alias("pooled"))
    names = sizes.join(per_language, sizes["lang"].eqNullSafe(per_language["l"]), "left").select(
        F.col("lang").alias("l2"), F.col("source").alias("s2"),
        F.when(F.col("count") >= least, fine).when(F.col("pooled") >= least, coarse).otherwise("all").alias("grp"))
    return rows.join(names, rows["lang"].eqNullSafe(F.col("l2")) & rows["source"].eqNullSafe(F.col("s2")), "left").drop("l2", "s2")


def robust_distances(rows: DataFrame, keys: list[str], x: list[Column], least: int = GROUP_ROWS, steps: int = STEPS, share: float = KEPT_SHARE) -> DataFrame:
    """``keys`` and d2, the squared distance from the row's group by its minimum covariance determinant estimate.

    ``rows`` has lang, source (null is a value of its own) and what ``x`` needs. Two starts, the medians with the
    spread of the nearest half and the plain moments, each take ``steps`` concentration steps: the ``share`` of a group
    nearest to the last estimate gives the next one. The smaller determinant wins.
    """
    names = [f"x{i}" for i in range(P)]
    table = written(_groups(rows, least).select(*keys, "grp", *[c.alias(n) for c, n in zip(x, names)]), "vectors")
    cols = [F.col(n) for n in names]
    medians = table.groupBy("grp").agg(*[F.percentile_approx(n, 0.5, 1000).alias(f"c{n}") for n in names])
    off = F.greatest(*[F.abs(F.col(n) - F.col(f"c{n}")) / f for n, f in zip(names, FLOORS)])
    near = table.join(medians.withColumnRenamed("grp", "g"), F.col("grp") == F.col("g")).select("grp", *names, off.alias("off"))
    half = near.groupBy("grp").agg(F.percentile_approx("off", 0.5, 1000).alias("cut")).withColumnRenamed("grp", "g")
    central = near.join(half, F.col("grp") == F.col("g")).where("off <= cut").groupBy("grp").agg(*_moments(cols)).withColumn("start", F.lit(0))
    plain = table.groupBy("grp").agg(*_moments(cols)).withColumn("start", F.lit(1))
    fit = written(_fitted(central.unionByName(plain)), "fit")
    for _ in range(steps):
        scored = table.join(fit.withColumnRenamed("grp", "g"), F.col("grp") == F.col("g")).select("grp", "start", *names, _distance(cols).alias("d2"))
        cut = scored.groupBy("grp", "start").agg(F.percentile_approx("d2", share, 1000).alias("cut")).select(F.col("grp").alias("g"), F.col("start").alias("s"), "cut")
        nearest = scored.join(cut, (F.col("grp") == F.col("g")) & (F.col("start") == F.col("s"))).where("d2 <= cut")
        fit = written(_fitted(nearest.groupBy("grp", "start").agg(*_moments(cols))), "fit")
    best = fit.groupBy("grp").agg(F.min_by(F.struct(*[c for c in fit.columns if c not in ("grp", "start")]), F.struct("logdet", "start")).alias("b")).select(F.col("grp").alias("g"), "b.*")
    return table.join(best, F.col("grp") == F.col("g")).select(*keys, _distance(cols).alias("d2"))


def judged(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", source_column: str = "source", cut: float = CUT) -> DataFrame:
    """Per row: the id, COUNTS, base_failed, d2 (null where a base rule failed) and kept.

    Null language or source is a value of its own; a null or empty text has no words and fails. Extra columns are
    left out, repeated rows give repeated results, an empty table gives no row.
    """
    plain = documents.select(F.col(id_column).alias("key"), F.col(lang_column).alias("lang"), F.col(source_column).alias("source"), F.col(text_column).alias("body"))
    table = written(counts(plain, ("key", "lang", "source"), "body").withColumn("base_failed", base_failed()), "counts")
    sound = robust_distances(table.where("NOT base_failed"), ["key", *COUNTS], vector()).withColumn("base_failed", F.lit(False))
    failed = table.where("base_failed").select("key", *COUNTS, F.lit(None).cast("double").alias("d2"), "base_failed")
    return sound.unionByName(failed).select(F.col("key").alias(id_column), *COUNTS, "base_failed", "d2", (~F.col("base_failed") & (F.col("d2") <= cut)).alias("kept"))
