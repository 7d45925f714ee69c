"""Streams over task events and requests."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from studyspark.functions import fixed as fx
from studyspark.operators.telemetry import POLLER_LIMIT, PROCESSING_LIMIT, REQUEST_LIMIT, REQUEST_WINDOW, TASK_TTL, over_limit

_STATE = """started BIGINT, updated BIGINT, error_us BIGINT, error_id BIGINT, due BIGINT, done ARRAY<STRING>, failed ARRAY<STRING>,
  statuses ARRAY<STRING>, errors ARRAY<STRING>"""
_OUTPUT = "progress INT, failed_steps INT, status STRING, error_message STRING, started_at TIMESTAMP, updated_at TIMESTAMP"


class TaskProgress(StatefulProcessor):
    """State of one task in one value: its completed and failed steps, each once, and a status and error for each of ``limits``. A
    task that is not finished so many seconds after its start fails without a further event of its own; ``idle_seconds`` after
    its last event its state goes. One timer in event time is set at a time, for the next of these moments.

    Every call of the state or a timer is a message to the JVM, so a batch of events of a task takes one read and one write,
    and sets its timer only when that moves."""

    def __init__(self, limits: tuple[int, ...], idle_seconds: int) -> None:
        self.limits, self.idle_seconds = limits, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _STATE)
        self.weights = dict(fx.STEP_WEIGHTS)

    def _deadline(self, started: int, seconds: int) -> int:
        return started // 1000 + (seconds + 1) * 1000      # more than so many whole seconds

    def _end(self, updated: int) -> int:
        return updated // 1000 + self.idle_seconds * 1000

    def _due(self, started: int, updated: int, statuses: list[str]) -> int:
        return min([self._end(updated), *(self._deadline(started, s) for s, status in zip(self.limits, statuses) if status == "processing")])

    def _rows(self, key, started, updated, done, failed, statuses, errors, chosen) -> Iterator[Row]:
        progress = sum(self.weights.get(step, 0) for step in done)
        for i in chosen:
            yield _ROW(*key, self.limits[i], progress, len(failed), statuses[i], errors[i], _time(started), _time(updated))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = len(self.limits)
        started, updated, error_us, error_id, due, done, failed, statuses, errors = self.task.get() or (
            None, None, -(2 ** 62), -1, None, [], [], ["processing"] * n, [None] * n)
        done, failed, statuses, errors = list(done), list(failed), list(statuses), list(errors)
        for row in rows:
            step, state, at, number = row.step, row.status, row.at_us, row.event_id
            started, updated = at if started is None else min(started, at), at if updated is None else max(updated, at)
            if state == "completed" and step not in done:
                done.append(step)
            if state == "failed":
                if step not in failed:
                    failed.append(step)
                if (at, number) > (error_us, error_id):
                    errors, error_us, error_id = [row.error] * n, at, number
            if step == "finalize" and state == "completed":
                statuses = ["completed"] * n
        now = self._due(started, updated, statuses)
        self.task.update((started, updated, error_us, error_id, now, done, failed, statuses, errors))
        if due != now:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(now)
        yield from self._rows(key, started, updated, done, failed, statuses, errors, range(n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.task.get()
        if state is None:
            return
        started, updated, error_us, error_id, _, done, failed, statuses, errors = state
        statuses, errors = list(statuses), list(errors)
        # The watermark may have passed several moments at once.
        past = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        late = [i for i, s in enumerate(self.limits) if statuses[i] == "processing" and self._deadline(started, s) <= past]
        for i in late:
            statuses[i], errors[i] = "failed", f"timeout after {self.limits[i]} seconds"
        if self._end(updated) <= past:
            self.task.clear()
        else:
            due = self._due(started, updated, statuses)
            self.task.update((started, updated, error_us, error_id, due, done, failed, statuses, errors))
            self.handle.registerTimer(due)
        yield from self._rows(key, started, updated, done, failed, statuses, errors, late)

    def close(self) -> None:
        pass


_ROW = Row("task_id", "seconds", *(c.split()[0] for c in _OUTPUT.split(", ")))
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _time(us: int) -> datetime:
    return _EPOCH + timedelta(microseconds=us)


def task_limits_stream(events: DataFrame, lateness: str = "1 hour", limits: tuple[int, ...] = (PROCESSING_LIMIT, POLLER_LIMIT), idle_seconds: int = TASK_TTL) -> DataFrame:
    """``task_state_stream`` under several limits at once: one row per task and limit, named by ``seconds``."""
    rows = events.withWatermark("ts", lateness).select("task_id", "step", "status", "error", "ts", F.unix_micros("ts").alias("at_us"), "event_id")
    schema = f"task_id {events.schema['task_id'].dataType.simpleString()}, seconds BIGINT, {_OUTPUT}"
    return rows.groupBy("task_id").transformWithState(TaskProgress(tuple(limits), idle_seconds), schema, "update", "eventTime")


def task_state_stream(events: DataFrame, lateness: str = "1 hour", seconds: int = PROCESSING_LIMIT, idle_seconds: int = TASK_TTL) -> DataFrame:
    """Per task: progress from its distinct completed steps, number of failed steps, status, latest error, start and last change.
    Update mode. A task fails when the watermark passes its start by more than ``seconds``; its state goes when the watermark
    passes its last event by ``idle_seconds``. Events are (task_id, step, status, error, ts, event_id)."""
    return task_limits_stream(events, lateness, (seconds,), idle_seconds).drop("seconds")


def task_progress_stream(events: DataFrame) -> DataFrame:
    """Per task: progress from its distinct completed steps and number of different failed steps. Update mode, as a streaming
    aggregation without Python; states stay, and late events count."""
    done = [F.coalesce(F.max(F.when((F.col("step") == name) & (F.col("status") == "completed"), weight)), F.lit(0)) for name, weight in fx.STEP_WEIGHTS]
    failed = F.size(F.collect_set(F.when(F.col("status") == "failed", F.col("step"))))
    return events.groupBy("task_id").agg(sum(done[1:], done[0]).alias("progress"), failed.alias("failed_steps"))


def over_limit_stream(requests: DataFrame, limit: int = REQUEST_LIMIT, window: str = REQUEST_WINDOW, lateness: str = "5 minutes") -> DataFrame:
    """Clients above the request limit per window. In append mode a window appears once it is closed, in update mode whenever it changes."""
    return over_limit(requests.withWatermark("ts", lateness), limit, window)
