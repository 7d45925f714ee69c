import numpy as np
from pyspark.sql import functions as F

from studyspark.functions import vectors as fv
from studyspark.operators import vectors as ov


def test_hash_embedding_is_stable_and_of_unit_length(spark):
    df = spark.createDataFrame([(1, "cell"), (2, " cell "), (3, "  "), (4, "atom")], "id int, text string")
    got = {r.id: np.array(r.vector) for r in ov.embed(df, dim=64).collect()}
    assert np.array_equal(got[1], got[2]) and not np.array_equal(got[1], got[4])
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-5 and not got[3].any()


def test_cosine_and_fit(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<float>, b array<float>")
    got = [round(r.c, 6) for r in df.select(fv.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [0.707107, 0.0, 0.0]
    fitted = df.select(fv.fit_normalize(F.col("b"), 3).alias("v")).first().v
    assert [round(x, 6) for x in fitted] == [0.707107, 0.707107, 0.0]


def test_clusters_shrink_to_the_number_of_cards(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [9.0, 0.0]), (3, [0.0, 1.1])], "id int, vector array<float>")
    got = {r.id: r.cluster for r in ov.cluster_cards(df, k=2, restarts=2).collect()}
    assert got[1] == got[3] != got[2]
    assert {r.id for r in ov.cluster_cards(df, k=9, restarts=1).collect()} == {1, 2, 3}
