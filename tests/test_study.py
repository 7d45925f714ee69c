import datetime as dt
import random

from studyspark.operators import graph_build, graph_query, study, telemetry
from pyspark.sql import functions as F

from studyspark.functions.sm2 import next_state
from studyspark.streaming import reviews as sr
from studyspark.streaming.run import latest, run_available


def history(n, cards, seed=1):
    rnd, at = random.Random(seed), dt.datetime(2024, 1, 1)
    out = []
    for i in range(n):
        at += dt.timedelta(minutes=rnd.randint(1, 50))
        out.append((rnd.randint(1, 3), rnd.randint(1, cards), i, rnd.randint(0, 5), at))
    return out


SCHEMA = "user_id bigint, card_id bigint, review_id bigint, quality int, reviewed_at timestamp_ntz"


def test_known_sequence(spark):
    rows = [(1, 1, i, q, dt.datetime(2024, 1, 1 + i)) for i, q in enumerate([5, 4, 2, 5, 5])]
    state = study.sm2_replay(spark.createDataFrame(rows, SCHEMA)).first()
    assert (state.repetitions, state.interval, round(state.ef, 6)) == (2, 6.0, 2.48)
    assert state.next_review_date == dt.date(2024, 1, 11)


def test_replay_equals_the_loop_and_goes_on_from_a_state(spark):
    rows = history(600, 4) + [(9, 9, 10_000 + i, i % 6, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(15_000)]      # a long one
    want = {}
    for user, card, _, quality, _ in sorted(rows, key=lambda r: (r[4], r[2])):
        want[(user, card)] = next_state(*want.get((user, card), (0, 0.0, 2.5)), quality)
    cut = sorted(r[4] for r in rows)[len(rows) // 2]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)

    def got(state):
        return {(r.user_id, r.card_id): (r.repetitions, r.interval, r.ef) for r in state.collect()}
    assert got(study.sm2_replay(df)) == want
    first = study.sm2_replay(df.where(F.col("reviewed_at") < F.lit(cut)))
    later = study.sm2_replay(df.where(F.col("reviewed_at") >= F.lit(cut)), first)
    assert got(first) | got(later) == want
    counts = {(r.user_id, r.card_id): r.reviews for r in [*first.collect(), *later.collect()]}
    assert counts == {(r.user_id, r.card_id): r.n for r in df.groupBy("user_id", "card_id").agg(F.count("*").alias("n")).collect()}
    assert study.sm2_replay(df.limit(0)).count() == 0


def test_stream_drops_late_reviews(spark, tmp_path):
    schema = "user_id bigint, card_id bigint, review_id bigint, quality int, at_us bigint"
    first = [(1, 1, 0, 5, 1000), (1, 1, 1, 5, 2000)]
    second = [(1, 1, 2, 1, 1500), (1, 1, 3, 4, 3000)]     # one review comes too late
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = latest(run_available(sr.sm2_stream(stream), "update", "test"), ["user_id", "card_id"]).first()
    assert (out.repetitions, out.interval, out.reviews, out.dropped) == (3, 16.0, 3, 1)


def test_k_hop_visits_each_node_once(spark):
    edges = spark.createDataFrame([(1, 1, 2, "R", 1.0), (2, 2, 3, "R", 1.0), (3, 1, 3, "R", 1.0), (4, 3, 1, "R", 1.0), (5, 3, 4, "R", 1.0)],
                                  "edge_id int, source int, target int, type string, weight double")
    got = graph_query.k_hop(spark.createDataFrame([(1,)], "start int"), edges, 2)
    assert {(r.node, r.depth, r.edge_id) for r in got.collect()} == {(2, 1, 1), (3, 1, 3), (4, 2, 5)}


def test_topic_tree_ends_on_cycles(spark):
    edges = spark.createDataFrame([("b", "a", "PART_OF"), ("c", "b", "PART_OF"), ("a", "c", "PART_OF")], "source string, target string, type string")
    got = graph_query.topic_tree(edges, spark.createDataFrame([("a",)], "node string"))
    assert {(r.node, r.depth) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_learning_path_is_shortest(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("a", "w"), ("w", "d")]
    edges = spark.createDataFrame([(s, t, "PREREQUISITE") for s, t in rows], "source string, target string, type string")
    pairs = spark.createDataFrame([("a", "d"), ("d", "a")], "start string, end string")
    got = {(r.start, r.end): r.path for r in graph_query.learning_path(pairs, edges).collect()}
    assert got == {("a", "d"): ["a", "w", "d"], ("d", "a"): None}


def test_mutual_definitions(spark):
    nodes = spark.createDataFrame([("Force", "Force relates to Mass."), ("Mass", "Mass resists force.")], "label string, definition string")
    assert {(r.source, r.target) for r in graph_build.related_by_definition(nodes).collect()} == {("Force", "Mass"), ("Mass", "Force")}


def test_redact(spark):
    df = spark.createDataFrame([('{"userPassword":"x","name":"n","refreshtoken":"t"}',)], "body string")
    assert telemetry.redact(df).first().body == {"userPassword": "[REDACTED]", "name": "n", "refreshtoken": "[REDACTED]"}
