"""Streams: resuming from a folder, and a source without input."""

from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.operators import telemetry
from studyspark.plans import views
from studyspark.session import scratch_path
from studyspark.streaming.reviews import sm2_stream
from studyspark.streaming.run import latest, run_available
from studyspark.streaming.tasks import task_limits_stream, task_progress_stream, task_state_stream

SCHEMA = "id bigint, name string"


def write(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_a_later_run_goes_on_where_the_last_one_stopped(spark):
    source, target = scratch_path(spark, "source"), scratch_path(spark, "target")
    write(spark, source, [(1, "a"), (2, "b")], "one")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(source)
        return sorted((r.id, r.batch_id) for r in run_available(stream, "append", "rows", target).collect())
    first = run()
    assert [i for i, _ in first] == [1, 2]
    assert run() == first                                   # nothing new: nothing twice
    write(spark, source, [(3, "c")], "two")
    later = run()
    assert later[:2] == first and later[2][0] == 3 and later[2][1] > first[0][1]


def test_a_source_without_input_gives_an_empty_table(spark):
    source = scratch_path(spark, "source")
    spark.createDataFrame([], SCHEMA).limit(0).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    rows = run_available(stream, "append", "rows")
    assert rows.columns == ["id", "name", "batch_id"] and rows.count() == 0


def test_windows_open_at_the_end_are_written(spark):
    sf = "/root/testdata/sf0.001"
    queries = __import__("__spark_entry__").queries()
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type AS client", "CAST(ts AS timestamp) AS ts")
    want = events.groupBy("client", F.window("ts", "15 minutes")).count().where("count > 2").count()
    assert queries["i13_over_limit_stream"](spark, sf).count() == want
    reviews = views.as_reviews(spark.read.parquet(f"{sf}/events.parquet"))
    want = reviews.groupBy("user_id", F.window(F.col("reviewed_at").cast("timestamp"), "1 day")).count().count()
    assert queries["i14_study_stats_stream"](spark, sf).count() == want


REVIEWS = "user_id bigint, card_id bigint, review_id bigint, quality int, at_us bigint"


def test_card_state_survives_restarts_counts_late_reviews_and_expires(spark):
    source = scratch_path(spark, "source")
    targets = {idle: scratch_path(spark, "target") for idle in (None, 600)}

    def run(rows, name):
        rows = spark.createDataFrame(rows, "user_id bigint, card_id bigint, review_id bigint, quality int, s bigint")
        rows.withColumn("at_us", F.col("s") * 1000000).drop("s").withColumn("reviewed_at", F.timestamp_micros("at_us")).coalesce(1).write.parquet(f"{source}/{name}")
        out = {}
        for idle, target in targets.items():
            stream = spark.readStream.schema(REVIEWS + ", reviewed_at timestamp").option("recursiveFileLookup", "true").parquet(source)
            rows = latest(run_available(sm2_stream(stream, idle, "1 second"), "update", "cards", target), ["user_id", "card_id"]).collect()
            out[idle] = {(r.user_id, r.card_id): (r.repetitions, r.interval, r.reviews, r.dropped) for r in rows}
        return out
    first = run([(1, 1, 1, 5, 100), (1, 1, 2, 4, 200), (2, 1, 3, 1, 5000)], "one")
    assert first[None] == first[600] == {(1, 1): (2, 6.0, 2, 0), (2, 1): (0, 1.0, 1, 0)}
    later = run([(1, 1, 4, 5, 5001), (1, 1, 5, 5, 150)], "two")
    assert later[None][1, 1] == (3, 16.0, 3, 1)           # goes on; the late review is only counted
    assert later[600][1, 1] == (1, 1.0, 1, 0)             # idle for long: the old state is gone


TASKS = "task_id bigint, step string, status string, error string, ts timestamp, event_id bigint"


def _tasks(spark, source, rows, name):
    frame = spark.createDataFrame(rows, "task_id bigint, step string, status string, error string, s double, event_id bigint")
    frame.select("task_id", "step", "status", "error", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"), "event_id").coalesce(1).write.parquet(f"{source}/{name}")


def test_tasks_time_out_without_an_event_of_their_own(spark):
    start = 1_700_000_000.0
    rows = [(1, "ocr", "completed", None, start, 1), (2, "ocr", "completed", None, start + 400.5, 2), (2, "finalize", "completed", None, start + 420, 3),
            (3, "ocr", "failed", "bad", start + 500.25, 4), (3, "ocr", "failed", "worse", start + 510, 5), (4, "ocr", "completed", None, start + 900, 6), (5, "ocr", "completed", None, start + 1000, 7)]
    source = scratch_path(spark, "source")
    _tasks(spark, source, rows, "one")
    events = spark.read.option("recursiveFileLookup", "true").parquet(source)
    for seconds in (telemetry.PROCESSING_LIMIT, telemetry.POLLER_LIMIT):
        stream = spark.readStream.schema(TASKS).option("recursiveFileLookup", "true").parquet(source)
        got = latest(run_available(task_state_stream(stream, "10 seconds", seconds), "update", "tasks"), ["task_id"])
        want = telemetry.mark_timeouts(telemetry.task_state(events), F.timestamp_micros(F.lit(int((start + 990) * 1e6))), seconds)
        assert {(r.task_id, r.status, r.error_message) for r in got.collect()} == {(r.task_id, r.status, r.error_message) for r in want.collect()}


def test_idle_tasks_begin_anew(spark):
    source, target = scratch_path(spark, "source"), scratch_path(spark, "target")

    def run():
        stream = spark.readStream.schema(TASKS).option("recursiveFileLookup", "true").parquet(source)
        rows = latest(run_available(task_state_stream(stream, "1 second", 60, 600), "update", "tasks", target), ["task_id"]).collect()
        return {r.task_id: (r.failed_steps, r.status) for r in rows}
    _tasks(spark, source, [(1, "ocr", "failed", "a", 1000.0, 1), (2, "ocr", "completed", None, 1001.0, 2)], "one")
    assert run() == {1: (1, "processing"), 2: (0, "processing")}
    _tasks(spark, source, [(1, "nlp", "failed", "b", 1030.0, 3)], "two")
    assert run()[1] == (2, "processing")                  # the state of the first run is still there
    _tasks(spark, source, [(3, "ocr", "completed", None, 9000.0, 4)], "three")
    assert run() == {1: (2, "failed"), 2: (0, "failed"), 3: (0, "processing")}
    _tasks(spark, source, [(1, "ocr", "failed", "c", 9001.0, 5)], "four")
    assert run()[1] == (1, "processing")                  # idle for long: its steps are forgotten


def test_several_limits_take_one_run(spark):
    start = 1_700_000_000.0
    rows = [(1, "ocr", "completed", None, start, 1), (1, "ocr", "failed", "bad", start + 1, 2), (2, "ocr", "completed", None, start + 400, 3),
            (3, "finalize", "completed", None, start, 4), (4, "ocr", "completed", None, start + 1000, 5)]
    source = scratch_path(spark, "source")
    _tasks(spark, source, rows, "one")
    stream = spark.readStream.schema(TASKS).option("recursiveFileLookup", "true").parquet(source)
    got = latest(run_available(task_limits_stream(stream, "10 seconds", (300, 600)), "update", "limits"), ["task_id", "seconds"])
    assert {(r.task_id, r.seconds): (r.status, r.error_message) for r in got.collect()} == {
        (1, 300): ("failed", "timeout after 300 seconds"), (1, 600): ("failed", "timeout after 600 seconds"),
        (2, 300): ("failed", "timeout after 300 seconds"), (2, 600): ("processing", None),
        (3, 300): ("completed", None), (3, 600): ("completed", None), (4, 300): ("processing", None), (4, 600): ("processing", None)}


def test_progress_goes_on_over_runs_without_python_state(spark):
    source, target = scratch_path(spark, "source"), scratch_path(spark, "target")

    def run():
        stream = spark.readStream.schema(TASKS).option("recursiveFileLookup", "true").parquet(source)
        rows = latest(run_available(task_progress_stream(stream), "update", "progress", target), ["task_id"]).collect()
        return {r.task_id: (r.progress, r.failed_steps) for r in rows}
    weights = dict(fx.STEP_WEIGHTS)
    _tasks(spark, source, [(1, "ocr", "completed", None, 10.0, 1), (1, "ocr", "completed", None, 11.0, 2), (2, "tidy_up", "failed", "a", 12.0, 3)], "one")
    assert run() == {1: (weights["ocr"], 0), 2: (0, 1)}
    _tasks(spark, source, [(1, "finalize", "completed", None, 9.0, 4), (2, "tidy_up", "failed", "b", 13.0, 5), (2, "ocr", "failed", "c", 1.0, 6)], "two")
    assert run() == {1: (weights["ocr"] + weights["finalize"], 0), 2: (0, 2)}
