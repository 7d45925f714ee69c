"""Embedding near duplicates and url filters against brute force and held-out labels."""

import numpy as np
import pytest

from studyspark.llm.components import components
from studyspark.llm.pq_dedup import near_duplicates
from studyspark.llm.url_filter import fit_url_filter, rule_labels


def brute(rows, least):
    """{id: (links, component)} of (id, vector, label) rows."""
    units = {}
    for k, v, label in rows:
        v = None if v is None or any(x is None for x in v) else np.array(v, float)
        ok = label is not None and v is not None and len(v) and np.isfinite(v).all() and v.any()
        v = v / np.abs(v).max() if ok else v
        units[k] = (label, v / np.linalg.norm(v)) if ok else None
    parent = {k: k for k in units}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = dict.fromkeys(units, 0)
    for a in units:
        for b in units:
            if a < b and units[a] and units[b] and units[a][0] == units[b][0] and len(units[a][1]) == len(units[b][1]) and units[a][1] @ units[b][1] >= least:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (links[k], find(k)) for k in units}


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(20 * c + i, (centre + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.2])).tolist(), c % 3) for i in range(20)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]                                   # copies
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, rows[0][1], None),
             (2005, [], 1), (2006, rows[0][1][:8], 0), (2007, rows[0][1][:8], 0), (2008, [x * 1e200 for x in rows[0][1]], 0), (2009, [float("inf")] * 16, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS digest", "3 AS n")
    for block_rows in (1024, 7):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(table, block_rows=block_rows, lists=6).collect()}
        assert got == brute(rows, 0.98)
    assert near_duplicates(table.limit(0)).count() == 0


def test_repeated_vector_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_duplicates(rows).collect())
    assert got == [(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_components_of_paths_stars_and_rings(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges] + [(7, 7), (3, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + [(None, 1)], "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 151)}, **{i: 200 for i in range(200, 209)}}


URLS = [("http://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"), ("HTTP://WWW.Example.COM/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("x://net/es/", "net", "/es/", "net/es/", "block"), ("x://b.net/esx", "b.net", "/esx", None, None), ("x://anet/es/", "anet", "/es/", None, None),
        ("http://example.com#/en/", "example.com", "", None, None), (None, "", "", None, None), ("example.com/en/", "", "", None, None), ("", "", "", None, None),
        ("http://example.com/de/a://b", "example.com", "/de/a://b", "com/", "allow"), ("http://h.org/" + "a" * 200_000, "h.org", "/" + "a" * 200_000, None, None)]


def test_url_rules(spark):
    table = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] + [(99, URLS[0][0])] * 2, "page_id int, url string").selectExpr("*", "'x' AS host", "'y' AS grams", "0 AS features")
    got = {r.page_id: r for r in fit_url_filter(rule_labels(table)).apply(table, "page_id").collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert fit_url_filter(rule_labels(table.limit(0))).apply(table.limit(0), "page_id").count() == 0


@pytest.mark.parametrize("seed", [1])
def test_url_model_on_held_out_urls(spark, seed):
    rng = np.random.default_rng(seed)
    def url(bad):
        word = "".join(rng.choice(list("abcdefgh"), 5))
        return f"http://{word}.{rng.choice(['casino', 'slots', 'poker']) if bad else rng.choice(['library', 'museum', 'school'])}{rng.integers(99)}.org/{word}"
    rows = [(i, url(i % 2), i % 2) for i in range(600)]
    train = spark.createDataFrame([(u, b) for i, u, b in rows if i < 400], "url string, label int")
    held = spark.createDataFrame([(i, u) for i, u, _ in rows if i >= 400], "page_id int, url string")
    verdicts = {r.page_id: r.verdict for r in fit_url_filter(train).apply(held, "page_id").collect()}
    assert np.mean([verdicts[i] == ("block" if b else "allow") for i, _, b in rows if i >= 400]) >= 0.95
