"""Streams over review events: incremental SM-2 and windowed study statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from studyspark.functions import sm2

STATE = "repetitions INT, interval DOUBLE, ef DOUBLE, last_at BIGINT, last_id BIGINT, reviews BIGINT, dropped BIGINT"
OUTPUT = "user_id BIGINT, card_id BIGINT, repetitions INT, interval DOUBLE, ef DOUBLE, last_us BIGINT, reviews BIGINT, dropped BIGINT"


class CardReplay(StatefulProcessor):
    """Folds the new reviews of one card in time order. A review older than the last applied one is dropped and counted,
    since its effect can no longer be placed. The state of a card ends ``idle_seconds`` after its last review, in event time."""

    def __init__(self, idle_seconds: int | None = None) -> None:
        self.idle_seconds = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", STATE)

    def _end(self, last_at: int) -> int:
        return last_at // 1000 + self.idle_seconds * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.card.exists()
        reps, interval, ease, last_at, last_id, reviews, dropped = self.card.get() if known else (0, 0.0, sm2.START_EASE, -(2 ** 62), -1, 0, 0)
        before = last_at
        for at, rid, quality in sorted((int(at), int(rid), int(q)) for pdf in rows for at, rid, q in zip(pdf["at_us"], pdf["review_id"], pdf["quality"])):
            if (at, rid) <= (last_at, last_id):
                dropped += 1
                continue
            reps, interval, ease = sm2.next_state(reps, interval, ease, quality)
            last_at, last_id, reviews = at, rid, reviews + 1
        self.card.update((reps, interval, ease, last_at, last_id, reviews, dropped))
        if self.idle_seconds and last_at != before:
            if known:
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(last_at))
        yield pd.DataFrame([(*key, reps, interval, ease, last_at, reviews, dropped)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.card.clear()
        yield from ()

    def close(self) -> None:
        pass


def sm2_stream(reviews: DataFrame, idle_seconds: int | None = None, lateness: str = "1 hour") -> DataFrame:
    """Updated state of every card touched by a micro-batch; update mode. Needs ``at_us``, the review time in microseconds.

    Without ``idle_seconds`` states stay and late reviews are counted. With it a card's state ends when the watermark of
    ``reviewed_at`` passes its last review by so much; reviews behind the watermark are then left out by Spark.
    """
    columns = ["user_id", "card_id", "review_id", "quality", "at_us"]
    if idle_seconds:
        reviews, columns = reviews.withWatermark("reviewed_at", lateness), [*columns, "reviewed_at"]
    return reviews.select(*columns).groupBy("user_id", "card_id").transformWithStateInPandas(CardReplay(idle_seconds), OUTPUT, "update", "eventTime" if idle_seconds else "none")


def study_stats_windows(reviews: DataFrame, window: str = "1 day") -> DataFrame:
    """Sessions, quality sum and seconds per user and window; batch and stream alike."""
    return reviews.groupBy(F.window("reviewed_at", window).alias("w"), "user_id").agg(
        F.count("*").alias("total_reviews"), F.avg("quality").alias("avg_quality"), F.sum("time_spent").alias("total_seconds")
    ).select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_reviews", "avg_quality", "total_seconds")


def study_stats_stream(reviews: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """The same on a stream. In append mode a window appears once it can receive no more reviews, in update mode whenever it changes."""
    return study_stats_windows(reviews.withWatermark("reviewed_at", lateness), window)
