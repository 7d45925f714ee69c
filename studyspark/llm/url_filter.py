"""Allow or block URLs: domain rules first, then logistic regression on hashed character n-grams.

Only DataFrame functions and the JVM's own feature and regression code run; no Python touches a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path) of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Most labelled rows the regression is fitted on; beyond it the rows of smallest hash are taken.
TRAIN_ROWS = 20_000
FEATURES = 1 << 14
GRAM = 3


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. A null url or one without ``://`` gives two empty strings."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written host then path, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):   # the longest ends outermost
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def characters(host: Column, path: Column) -> Column:
    """The characters of host and path as one array, each marked with its part; the parts have bounds, so it's never short."""
    def of(text: Column, mark: str) -> Column:
        return F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), lambda c: F.concat(F.lit(mark), c))
    return F.concat(F.array(F.lit("^")), of(host, "h"), F.array(F.lit("/")), of(path, "p"), F.array(F.lit("$")))


@dataclass
class UrlFilter:
    """A fitted filter. ``model`` is None when the labelled table lacks one of the two classes; ``fallback`` then decides."""

    model: LogisticRegressionModel | None
    fallback: str
    features: int
    gram: int

    def apply(self, urls: DataFrame, id_column: str, url_column: str = "url", rules=RULES) -> DataFrame:
        """One row per input row: the id, host, path, rule, verdict and block_score (null where a rule decides)."""
        host, path = url_parts(F.col(url_column))
        parts = urls.select(F.col(id_column), host.alias("host"), path.alias("path"))
        rule, decided = rule_columns(F.col("host"), F.col("path"), rules)
        parts = parts.select(id_column, "host", "path", rule.alias("rule"), decided.alias("decided"))
        if self.model is None:
            return parts.select(id_column, "host", "path", "rule", F.coalesce("decided", F.lit(self.fallback)).alias("verdict"),
                                F.lit(None).cast("double").alias("block_score"))
        scored = self.model.transform(_hashed(parts, self.features, self.gram))
        judged = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
        return scored.select(id_column, "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"),
                             F.when(F.col("decided").isNull(), vector_to_array("probability")[1]).alias("block_score"))


def _hashed(parts: DataFrame, features: int, gram: int) -> DataFrame:
    table = parts.withColumn("characters", characters(F.col("host"), F.col("path")))
    table = NGram(n=gram, inputCol="characters", outputCol="grams").transform(table)
    return HashingTF(numFeatures=features, inputCol="grams", outputCol="features", binary=True).transform(table).drop("characters", "grams")


def labelled_sample(labelled: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """At most ``most`` different labelled urls, (url, label): those of smallest hash, so the same ones in every run."""
    return labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("double").alias("label")).distinct() \
        .orderBy(F.xxhash64("url"), "url", "label").limit(most)


def fit_url_filter(labelled: DataFrame, features: int = FEATURES, gram: int = GRAM, reg: float = 1e-3, most: int = TRAIN_ROWS) -> UrlFilter:
    """Fit on a small labelled table of columns url and label (1 blocks, 0 allows).

    The fit takes at most ``most`` rows (documented bound). Classes are weighted to equal mass. With one class
    only, or no rows, there is nothing to separate: its verdict (``allow`` without rows) is given to every url.
    """
    sample = labelled_sample(labelled, most)
    counts = {float(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    if set(counts) != {0.0, 1.0}:
        return UrlFilter(None, "block" if set(counts) == {1.0} else "allow", features, gram)
    total = sum(counts.values())
    host, path = url_parts(F.col("url"))
    weight = F.when(F.col("label") == 1.0, total / (2 * counts[1.0])).otherwise(total / (2 * counts[0.0]))
    train = _hashed(sample.select("label", host.alias("host"), path.alias("path"), weight.alias("weight")), features, gram)
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, maxIter=40, standardization=False).fit(train)
    return UrlFilter(model, "allow", features, gram)


def rule_labels(urls: DataFrame, url_column: str = "url", rules=RULES) -> DataFrame:
    """Labelled urls (url, label) from the rows that a rule decides."""
    host, path = url_parts(F.col(url_column))
    parts = urls.select(F.col(url_column).alias("url"), host.alias("host"), path.alias("path"))
    _, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return parts.select("url", (verdict == "block").cast("int").alias("label")).where("label IS NOT NULL")
