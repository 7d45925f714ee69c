"""Rows that share an id but not their content: each keeps its own links, and none is lost."""

import random

import numpy as np

from studyspark.llm.pq_dedup import near_duplicates as near_vectors
from studyspark.llm.set_join import near_duplicates as near_texts
from studyspark.llm.url_filter import labelled_sample


def _components(ids, linked):
    """Smallest id in reach of each row, by plain search."""
    out, n = [], len(ids)
    for start in range(n):
        seen, todo = {start}, [start]
        while todo:
            i = todo.pop()
            for j in range(n):
                if j not in seen and linked(i, j):
                    seen.add(j)
                    todo.append(j)
        out.append(min(ids[i] for i in seen))
    return out


def test_vectors_of_one_id(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 16))
    vectors = [(centres[i % 6] + rng.normal(size=16) * 0.03) for i in range(30)]
    ids = list(range(30))
    ids[11], ids[20], ids[29] = 5, 7, 7                  # 5 and 7 stand on different vectors
    vectors += [vectors[11], vectors[3]]                 # and rows that repeat in full
    ids += [5, 3]
    units = [v / np.linalg.norm(v) for v in vectors]

    def linked(i, j):
        return i != j and units[i] @ units[j] >= 0.98
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = sorted(tuple(r) for r in near_vectors(table).collect())
    smallest = _components(ids, linked)
    want = sorted((i, sum(linked(k, j) for j in range(len(ids))), c, i == c) for k, (i, c) in enumerate(zip(ids, smallest)))
    assert got == want


def _texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    a, b, c = (" ".join(rng.choice(words) for _ in range(120)) for _ in range(3))
    return [(5, a), (5, b), (9, a + " more"), (7, b + " end"), (3, c), (3, c), (8, c), (None, a), (None, "alone and short"), (4, None), (4, "")]


def test_texts_of_one_id(spark):
    rows = _texts()

    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i:i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())
    sets = [grams(t) for _, t in rows]

    def linked(i, j):
        return i != j and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    known = [(i, s) for i, s in enumerate(sets) if rows[i][0] is not None]
    ids = [rows[i][0] for i, _ in known]
    smallest = _components(ids, lambda i, j: linked(known[i][0], known[j][0]))
    want = sorted((i, len(s), c) for i, (_, s), c in zip(ids, known, smallest))
    got = near_texts(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS size")).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert sorted((r.n_shingles, r.component_id or 0) for r in got if r.doc_id is None) == [(1, 0), (len(sets[0]), 5)]


def test_pipeline_keeps_one_of_each_group_and_all_else(spark):
    from corpus_pipeline import drop_near_duplicates
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in _texts()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = drop_near_duplicates(spark, docs, "").collect()
    rows = _texts()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 3, 4, 4, 5, 5] and {r.text for r in kept if r.doc_id == 5} == {rows[0][1], rows[1][1]}
    unique = docs.where("doc_id in (9, 7, 8) OR doc_id IS NULL")
    assert sorted(r.doc_id or 0 for r in drop_near_duplicates(spark, unique, "").collect()) == [0, 0, 7, 8, 9]


def test_a_hot_url_takes_one_place_of_the_sample(spark):
    rows = [("http://hot.com/", 1.0)] * 50 + [(f"http://h{i}.net/", 0.0) for i in range(5)]
    assert labelled_sample(spark.createDataFrame(rows, "url string, label double"), 6).distinct().count() == 6
