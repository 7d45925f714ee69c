"""SM-2 spaced repetition as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm: start and least easiness, first two intervals, pass mark.
START_EASE = 2.5
LEAST_EASE = 1.3
FIRST_INTERVAL = 1
SECOND_INTERVAL = 6
PASS_QUALITY = 3
BASE_GAIN = 0.1
LINEAR_LOSS = 0.08
SQUARE_LOSS = 0.02

# A day count beyond this is no date any more; the due date is then null.
LAST_DATED_INTERVAL = 2_000_000


def sm2_state(repetitions, interval, ease) -> Column:
    """The card state as one struct, with the types the fold needs."""
    return F.struct(
        F.coalesce(repetitions, F.lit(0)).cast("int").alias("repetitions"),
        F.coalesce(interval, F.lit(0)).cast("double").alias("interval"),
        F.coalesce(ease, F.lit(START_EASE)).cast("double").alias("ef"),
    )


def sm2_step(state: Column, quality: Column) -> Column:
    """State after one review. The interval grows by the easiness *before* this review."""
    passed = quality >= PASS_QUALITY
    reps = F.when(passed, state["repetitions"] + 1).otherwise(0)
    grown = F.floor(state["interval"] * state["ef"] + 0.5).cast("double")
    interval = (
        F.when(~passed | (reps == 1), F.lit(float(FIRST_INTERVAL)))
        .when(reps == 2, F.lit(float(SECOND_INTERVAL)))
        .when(grown == 0, F.lit(1.0))
        .otherwise(grown)
    )
    missing = F.lit(5) - quality
    ease = F.greatest(
        F.lit(LEAST_EASE),
        state["ef"] + (F.lit(BASE_GAIN) - missing * (F.lit(LINEAR_LOSS) + missing * F.lit(SQUARE_LOSS))),
    )
    return F.struct(reps.cast("int").alias("repetitions"), interval.alias("interval"), ease.alias("ef"))


def next_state(reps: int, interval: float, ease: float, quality: int) -> tuple[int, float, float]:
    """The same step as ``sm2_step``, for one review in Python."""
    if quality < PASS_QUALITY:
        reps, grown = 0, float(FIRST_INTERVAL)
    else:
        reps += 1
        if reps == 1:
            grown = float(FIRST_INTERVAL)
        elif reps == 2:
            grown = float(SECOND_INTERVAL)
        else:
            grown = float((interval * ease + 0.5) // 1) or 1.0
    missing = 5 - quality
    gain = BASE_GAIN - missing * (LINEAR_LOSS + missing * SQUARE_LOSS)
    return reps, grown, max(LEAST_EASE, ease + gain)


def due_date(reviewed_at: Column, interval: Column) -> Column:
    days = F.when(interval <= LAST_DATED_INTERVAL, interval.cast("int"))
    return F.date_add(F.to_date(reviewed_at), days)
