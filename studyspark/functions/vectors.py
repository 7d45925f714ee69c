"""Vector columns. Everything but the hash embedding stays in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from studyspark.functions.text import strip

DEFAULT_DIM = 512


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when a vector is empty or has no length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (size == 0), F.lit(0.0)).otherwise(dot(a, b) / size)


def fit(v: Column, dim: int) -> Column:
    """Cut or zero-pad to ``dim`` elements."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def fit_normalize(v: Column, dim: int) -> Column:
    """Fitted to ``dim`` and of unit length; a zero vector stays zero."""
    fitted = fit(v, dim)
    length = norm(fitted)
    return F.transform(fitted, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def text_seed(text: Column) -> Column:
    """First 32 bits of the text's SHA-256, null for blank text. Only this number goes to Python."""
    plain = strip(text)
    return F.when(plain != "", F.conv(F.substring(F.sha2(plain, 256), 1, 8), 16, 10).cast("bigint"))


def hash_embedding(seed: Column, dim: int = DEFAULT_DIM) -> Column:
    """A unit vector drawn from the seed; a null seed gives the zero vector."""

    @F.pandas_udf("array<float>")
    def draw(seeds: pd.Series) -> pd.Series:
        out = []
        for value in seeds:
            if pd.isna(value):
                out.append(np.zeros(dim, dtype=np.float32))
                continue
            v = np.random.default_rng(int(value)).standard_normal(dim, dtype=np.float32)
            length = np.linalg.norm(v)
            out.append(v / length if length > 0 else v)
        return pd.Series(out)

    return draw(seed)
