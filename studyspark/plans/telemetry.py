"""Telemetry queries. Events serve as task events, model calls and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.operators import telemetry as t
from studyspark.plans.registry import Catalog
from studyspark.plans.views import SQL, stamp, with_views
from studyspark.sources.tables import read_table

catalog = Catalog()
STEPS = [name for name, _ in fx.STEP_WEIGHTS]
AS_OF = "2024-01-15 00:00:00"

SQL["tasks"] = f"""
  SELECT event_id // 8 AS task_id, {STEPS}[event_id % 8 + 1] AS step, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN event_type = 'error' THEN 'e' || CAST(event_id AS VARCHAR) END AS error, ts, event_id FROM events"""
SQL["step_rows"] = """
  SELECT task_id, step, min(ts) FILTER (WHERE status = 'completed') AS done_at, arg_min(error, ts) FILTER (WHERE status = 'failed') AS first_error,
    min(ts) FILTER (WHERE status = 'failed') AS failed_at, max(ts) AS last_at FROM tasks GROUP BY ALL"""
SQL["states"] = """
  SELECT task_id, arg_max(step, last_at) AS current_step, coalesce(string_agg(step, ',' ORDER BY done_at) FILTER (WHERE done_at IS NOT NULL), '') AS steps_completed,
    coalesce(string_agg(step || ':' || first_error, ',' ORDER BY failed_at) FILTER (WHERE failed_at IS NOT NULL), '') AS steps_failed,
    bool_or(step = 'finalize' AND done_at IS NOT NULL) AS finished,
    coalesce(bool_or(failed_at IS NOT NULL AND step IN ('download', 'ocr', 'parse')), false) AS critical, bool_or(failed_at IS NOT NULL) AS any_failed
  FROM step_rows GROUP BY task_id"""
TASKS = "tasks step_rows states"


def task_events(events: DataFrame) -> DataFrame:
    step = F.get(F.array(*[F.lit(s) for s in STEPS]), (F.col("event_id") % 8).cast("int"))
    failed = F.col("event_type") == "error"
    return events.select(
        F.expr("event_id div 8").alias("task_id"), step.alias("step"), F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(failed, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"), "ts", "event_id",
    )


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return task_events(read_table(spark, sf, "events"))


def named(steps: str):
    return F.array_join(F.transform(steps, lambda x: F.concat_ws(":", x["step"], x["error"])), ",")


@catalog.add("i1_task_state", with_views(TASKS, """
SELECT task_id, current_step, steps_completed, steps_failed, coalesce(error, '') AS error_message FROM states
LEFT JOIN (SELECT task_id, arg_max(error, ts) AS error FROM tasks WHERE status = 'failed' GROUP BY 1) USING (task_id)"""))
def _(spark, sf):
    return t.task_state(tasks(spark, sf)).select(
        "task_id", "current_step", F.array_join("steps_completed", ",").alias("steps_completed"), named("steps_failed").alias("steps_failed"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


@catalog.add("i2_task_progress", with_views("tasks step_rows", f"""
SELECT task_id, step, CAST(sum(CASE step {" ".join(f"WHEN '{n}' THEN {w}" for n, w in fx.STEP_WEIGHTS)} END) OVER (PARTITION BY task_id ORDER BY done_at) AS BIGINT) AS progress
FROM step_rows WHERE done_at IS NOT NULL"""))
def _(spark, sf):
    return t.task_progress(tasks(spark, sf))


@catalog.add("i3_task_outcome", with_views(TASKS, """
SELECT task_id, CASE WHEN critical THEN 'failed' WHEN any_failed THEN 'partial_success' ELSE 'completed' END AS outcome FROM states"""))
def _(spark, sf):
    return t.task_outcome(t.task_state(tasks(spark, sf))).select("task_id", "outcome")


@catalog.add("i4_mark_timeouts", with_views(TASKS, f"""
SELECT s.task_id, CASE WHEN finished THEN 'completed' WHEN date_diff('second', m, TIMESTAMP '{AS_OF}') > 300 THEN 'failed' ELSE 'processing' END AS status
FROM (SELECT task_id, bool_or(task_id % 3 <> 0 AND step = 'finalize' AND done_at IS NOT NULL) AS finished FROM step_rows GROUP BY 1) s
JOIN (SELECT task_id, min(ts) AS m FROM tasks GROUP BY 1) x ON s.task_id = x.task_id"""))
def _(spark, sf):
    # Every third task does something else in place of its last step.
    events = tasks(spark, sf).withColumn("step", F.expr("CASE WHEN task_id % 3 = 0 AND step = 'finalize' THEN 'tidy_up' ELSE step END"))
    return t.mark_timeouts(t.task_state(events), F.lit(AS_OF).cast("timestamp_ntz")).select("task_id", "status")


SQL["calls"] = """
  SELECT CASE WHEN user_id % 2 = 0 THEN 'gpt-4' ELSE 'gpt-3.5-turbo' END AS model, ['parse', 'quiz', 'mindmap'][event_id % 3 + 1] AS op,
    CAST(floor(value) AS BIGINT) AS prompt_tokens, event_id % 100 AS completion_tokens, value AS duration_ms FROM events"""


@catalog.add("i6_llm_cost", with_views("calls", """
SELECT model, op, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  round(sum(CASE WHEN op = 'parse' THEN prompt_tokens / CAST(1000 AS DOUBLE) * CAST(CASE WHEN model = 'gpt-4' THEN 0.03 ELSE 0.0015 END AS DOUBLE)
      + completion_tokens / CAST(1000 AS DOUBLE) * CAST(CASE WHEN model = 'gpt-4' THEN 0.06 ELSE 0.002 END AS DOUBLE)
    ELSE (prompt_tokens + completion_tokens) / CAST(1000 AS DOUBLE) * CAST(CASE WHEN model = 'gpt-4' THEN 0.06 ELSE 0.002 END AS DOUBLE) END), 6) AS cost,
  round(avg(duration_ms), 6) AS avg_duration_ms FROM calls GROUP BY ALL"""))
def _(spark, sf):
    calls = read_table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, "gpt-4").otherwise("gpt-3.5-turbo").alias("model"),
        F.get(F.array(F.lit("parse"), F.lit("quiz"), F.lit("mindmap")), (F.col("event_id") % 3).cast("int")).alias("op"),
        F.floor("value").cast("bigint").alias("prompt_tokens"), (F.col("event_id") % 100).alias("completion_tokens"), F.col("value").alias("duration_ms"),
    )
    return t.llm_cost(calls).withColumn("cost", F.round("cost", 6)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("/api/"), "event_type").alias("path"),
        F.expr("CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END").alias("status_code"), F.col("value").alias("duration_ms"),
        F.col("event_type").alias("client"), "ts", (F.col("user_id") * 1000 + F.col("event_id") % 7).alias("request_id"), "event_id",
        F.col("event_type").alias("event"),
    )


@catalog.add("i7_request_stats", """
SELECT '/api/' || event_type AS path, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS class,
  count(*) AS requests, round(avg(value), 6) AS avg_ms, max(value) AS max_ms FROM events GROUP BY ALL""")
def _(spark, sf):
    return t.request_stats(requests(spark, sf)).withColumn("avg_ms", F.round("avg_ms", 6))


@catalog.add("i8_trace", """
WITH r AS (SELECT user_id * 1000 + event_id % 7 AS request_id, event_id, event_type AS event, epoch_us(ts) AS us FROM events)
SELECT request_id, event_id, event, us - min(us) OVER w AS offset_us, max(us) OVER w - min(us) OVER w AS span_us, count(*) OVER w AS lines
FROM r WINDOW w AS (PARTITION BY request_id)""")
def _(spark, sf):
    return t.trace(requests(spark, sf))


SQL["hashed"] = """
  SELECT doc_id AS id, lang, substr(sha256(text), 1, 16) || ':' || CASE WHEN length(text) % 2 = 0 THEN 'brief' ELSE 'detailed' END AS key FROM documents"""


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(F.length("text") % 2 == 0, "brief").otherwise("detailed").alias("mode")
    )
    return t.dedupe_by_hash(docs)


@catalog.add("i9_dedupe_by_hash", with_views("hashed", """
SELECT id, key, min(id) OVER (PARTITION BY key) AS source_id, id <> min(id) OVER (PARTITION BY key) AS cache_hit FROM hashed"""))
def _(spark, sf):
    return hashed(spark, sf)


@catalog.add("i9_hit_rate", with_views("hashed", """
SELECT split_part(key, ':', 2) AS mode, count(*) AS requests, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate
FROM (SELECT key, id <> min(id) OVER (PARTITION BY key) AS hit FROM hashed) GROUP BY 1"""))
def _(spark, sf):
    logs = hashed(spark, sf).withColumn("mode", F.split_part("key", F.lit(":"), F.lit(2)))
    return t.hit_rate(logs, ["mode"]).withColumn("hit_rate", F.round("hit_rate", 6))


@catalog.add("i10_drop_expired", f"""
SELECT event_id FROM events WHERE user_id % 10 <> 0 AND CASE event_id % 3 WHEN 0 THEN date_diff('second', ts, TIMESTAMP '2024-01-20') < 3600
  WHEN 1 THEN date_diff('second', ts, TIMESTAMP '2024-01-20') < 86400 ELSE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20' END""")
def _(spark, sf):
    rows = read_table(spark, sf, "events").select(
        "event_id", "ts", F.get(F.array(F.lit("result"), F.lit("task"), F.lit("token")), (F.col("event_id") % 3).cast("int")).alias("kind"),
        F.expr("ts + INTERVAL 7 DAY").alias("expires_at"), (F.col("user_id") % 10 == 0).alias("revoked"),
    )
    return t.drop_expired(rows, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


@catalog.add("i11_redact", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, '[REDACTED]' AS user_password, '[REDACTED]' AS access_token, event_type AS kind FROM events""")
def _(spark, sf):
    body = F.to_json(F.struct(
        F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("user_password"), F.col("event_id").alias("AccessTokenValue"), F.col("event_type").alias("kind"),
    ))
    rows = read_table(spark, sf, "events").select("event_id", body.alias("body"))
    m = F.col("body")
    return t.redact(rows).select("event_id", m["k"].alias("k"), m["user_password"].alias("user_password"), m["AccessTokenValue"].alias("access_token"), m["kind"].alias("kind"))


@catalog.add("i13_over_limit", """
SELECT event_type AS client, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS requests
FROM events GROUP BY 1, 2 HAVING count(*) > 2""")
def _(spark, sf):
    return t.over_limit(requests(spark, sf), limit=2).select("client", stamp(F.col("window_start")).alias("window_start"), "requests")
