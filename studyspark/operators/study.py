"""Study tracking: SM-2 schedules, due cards, statistics, dashboards, listings and audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from studyspark.functions.sm2 import due_date, next_state, sm2_state, sm2_step
from studyspark.operators.paging import top_n
from studyspark.session import ship_package

CARD = ["user_id", "card_id"]


def sm2_review(reviews: DataFrame) -> DataFrame:
    """One SM-2 step per row: state columns repetitions, interval, ef and a review (quality, reviewed_at)."""
    state = sm2_state(F.col("repetitions"), F.col("interval"), F.col("ef"))
    step = sm2_step(state, F.col("quality"))
    return (
        reviews.withColumn("_next", step)
        .withColumn("repetitions", F.col("_next.repetitions"))
        .withColumn("interval", F.col("_next.interval"))
        .withColumn("ef", F.col("_next.ef"))
        .withColumn("next_review_date", due_date(F.col("reviewed_at"), F.col("interval")))
        .drop("_next")
    )


def _folded(rows: DataFrame) -> DataFrame:
    """The state of each card after its rows, which lie together and in order. Rows stream through, so a task holds the state of
    one card and a batch, however long a history is."""
    schema = StructType([*rows.schema.fields[:2], StructField("repetitions", IntegerType()), StructField("interval", DoubleType()), StructField("ef", DoubleType()),
                         rows.schema["reviewed_at"], StructField("reviews", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        card, at, state, done, types = None, None, None, [], None

        def emit() -> pa.RecordBatch:
            columns = [pa.array(column, kind) for column, kind in zip(zip(*done), types)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type, pa.int32(), pa.float64(), pa.float64(), batch.schema.field(2).type, pa.int64()]
            when = batch.column(2)
            for i, (user, number, *first, quality) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7)))):
                if state is None or (user, number) != card:
                    if state is not None:
                        done.append((*card, *state, at, reviews))
                    card, (reps, interval, ease, reviews) = (user, number), first
                    state = reps, interval, ease
                if quality is not None:
                    state, reviews = next_state(*state, quality), reviews + 1
                at = when[i]
            if len(done) > 10_000:
                yield emit()
                done = []
        if state is not None:
            done.append((*card, *state, at, reviews))
        if done:
            yield emit()

    return rows.mapInArrow(run, schema)


def sm2_replay(reviews: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """State of every card after its whole history: repetitions, interval, ef, next_review_date, reviews. With ``start`` (states
    as returned here), cards go on from there, and those without a new review are left out.

    Reviews are sorted by card and time within partitions of cards, and folded as they stream by: one shuffle at any length.
    A review without a quality changes nothing but the date.
    """
    ship_package(reviews.sparkSession)
    rows = reviews.select(*CARD, "reviewed_at", "review_id", F.col("quality").cast("int").alias("quality"))
    if start is not None:
        known = start.select(*CARD, "repetitions", "interval", "ef", F.col("reviews").alias("_n"))
        rows = rows.join(known, CARD, "left")
    else:
        rows = rows.select("*", *[F.lit(None).alias(c) for c in ("repetitions", "interval", "ef", "_n")])
    state = sm2_state(F.col("repetitions"), F.col("interval"), F.col("ef"))
    rows = rows.withColumn("_s", state).select(*CARD, "reviewed_at", "_s.repetitions", "_s.interval", "_s.ef", F.coalesce("_n", F.lit(0)).cast("bigint").alias("reviews"), "quality", "review_id")
    ordered = rows.repartition(*CARD).sortWithinPartitions(*CARD, "reviewed_at", "review_id").drop("review_id")
    folded = _folded(ordered).withColumnRenamed("reviewed_at", "last_reviewed_at")
    return folded.withColumn("next_review_date", due_date(F.col("last_reviewed_at"), F.col("interval")))


def due_cards(cards: DataFrame, as_of, n: int = 20, ties: tuple[str, ...] = ("card_id",)) -> DataFrame:
    """Cards due at ``as_of``, oldest due date first, at most ``n`` per user."""
    due = cards.filter(F.col("next_review_date") <= F.lit(as_of).cast("date"))
    return top_n(due, ["user_id"], [F.col("next_review_date"), *map(F.col, ties)], n)


def list_cards(cards: DataFrame, by: str = "user_id", n: int = 50, offset: int = 0, as_of=None,
               ties: tuple[str, ...] = ("card_id",)) -> DataFrame:
    """A page of cards per user or note in next-review order, optionally only the due ones."""
    if as_of is not None:
        cards = cards.filter(F.col("next_review_date") <= F.lit(as_of).cast("date"))
    return top_n(cards, [by], [F.col("next_review_date"), *map(F.col, ties)], n, offset)


def _between(df: DataFrame, column: str, start, end) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return df


def study_stats(reviews: DataFrame, start=None, end=None, users: DataFrame | None = None) -> DataFrame:
    """Sessions, mean quality and total seconds per user in a date range. Users without a session
    appear with zeros when ``users`` is given."""
    stats = _between(reviews, "reviewed_at", start, end).groupBy("user_id").agg(
        F.count("*").alias("total_reviews"),
        F.avg("quality").alias("avg_quality"),
        F.coalesce(F.sum("time_spent"), F.lit(0)).alias("total_seconds"),
    )
    if users is None:
        return stats
    return users.select("user_id").join(stats, "user_id", "left").na.fill(0, ["total_reviews", "avg_quality", "total_seconds"])


def card_stats(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("card_id").agg(F.count("*").alias("reviews"), F.avg("quality").alias("avg_quality"))


def list_sessions(reviews: DataFrame, start=None, end=None, n: int = 50, offset: int = 0) -> DataFrame:
    """A page of sessions per user, newest first, with the true total of the range."""
    ranged = _between(reviews, "reviewed_at", start, end)
    totals = ranged.groupBy("user_id").agg(F.count("*").alias("total"))
    page = top_n(ranged, ["user_id"], [F.desc("reviewed_at"), F.desc("review_id")], n, offset)
    return page.join(totals, "user_id")


def latest_reviews(reviews: DataFrame, n: int = 10) -> DataFrame:
    return top_n(reviews, ["card_id"], [F.desc("reviewed_at"), F.desc("review_id")], n)


def dashboard(users: DataFrame, subjects: DataFrame, notes: DataFrame, cards: DataFrame, as_of, recent: int = 5) -> DataFrame:
    """Per user: subjects, notes, cards, due cards and the newest subjects. Every table is
    counted before it is joined, so no join multiplies rows."""
    due = F.col("next_review_date") <= F.lit(as_of).cast("date")
    newest = (
        top_n(subjects, ["user_id"], [F.desc("created_at"), F.col("name")], recent)
        .groupBy("user_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("recent_subjects"))
    )
    counts = [
        subjects.groupBy("user_id").agg(F.count("*").alias("total_subjects")),
        notes.groupBy("user_id").agg(F.count("*").alias("total_notes")),
        cards.groupBy("user_id").agg(F.count("*").alias("total_flashcards"), F.count_if(due).alias("due_flashcards")),
    ]
    out = reduce(lambda a, b: a.join(b, "user_id", "left"), [*counts, newest], users.select("user_id"))
    return out.na.fill(0, ["total_subjects", "total_notes", "total_flashcards", "due_flashcards"]).withColumn(
        "recent_subjects", F.coalesce("recent_subjects", F.array().cast("array<string>"))
    )


def card_dashboard(cards: DataFrame, reviews: DataFrame, as_of) -> DataFrame:
    """Per user: total cards, due cards, reviews; users known to only one of the tables included."""
    due = F.col("next_review_date") <= F.lit(as_of).cast("date")
    left = cards.groupBy("user_id").agg(F.count("*").alias("total_cards"), F.count_if(due).alias("due_cards"))
    right = reviews.groupBy("user_id").agg(F.count("*").alias("total_reviews"), F.avg("quality").alias("avg_quality"))
    return left.join(right, "user_id", "full_outer").na.fill(0)


def subject_rollup(subjects: DataFrame, chapters: DataFrame, notes: DataFrame) -> DataFrame:
    """Per subject: its chapters and notes, zero where it has none."""
    c = chapters.groupBy("subject_id").agg(F.count("*").alias("chapters"))
    n = notes.groupBy("subject_id").agg(F.count("*").alias("notes"))
    return subjects.select("subject_id").join(c, "subject_id", "left").join(n, "subject_id", "left").na.fill(0)


def note_rollup(notes: DataFrame) -> DataFrame:
    """Note counts per (subject, chapter), per subject and overall, in one pass."""
    return notes.rollup("subject_id", "chapter_id").agg(
        F.count("*").alias("notes"), F.grouping_id().cast("int").alias("level")
    )


def list_notes(notes: DataFrame, by: list[str], n: int = 50, offset: int = 0) -> DataFrame:
    """A page of notes per user / subject / chapter / status, newest first."""
    return top_n(notes, by, [F.desc("created_at"), F.desc("note_id")], n, offset)


def status_queue(notes: DataFrame, n: int = 50) -> DataFrame:
    """The oldest notes waiting in every processing status."""
    return top_n(notes, ["status"], [F.col("created_at"), F.col("note_id")], n)


def status_counts(notes: DataFrame, statuses: list[str]) -> DataFrame:
    return notes.groupBy("user_id").pivot("status", statuses).count().na.fill(0)


def list_chapters(chapters: DataFrame, n: int = 50, offset: int = 0) -> DataFrame:
    return top_n(chapters, ["subject_id"], [F.col("order_index"), F.col("created_at"), F.col("chapter_id")], n, offset)


def list_subjects(subjects: DataFrame, n: int = 50, offset: int = 0) -> DataFrame:
    return top_n(subjects, ["user_id"], [F.desc("created_at"), F.col("name")], n, offset)


def list_users(users: DataFrame, by: list[str], active: bool | None = None, verified: bool | None = None,
               n: int = 50, offset: int = 0) -> DataFrame:
    """A page of users per group of ``by``, newest first, with optional flag filters."""
    if active is not None:
        users = users.filter(F.col("is_active") == active)
    if verified is not None:
        users = users.filter(F.col("email_verified") == verified)
    return top_n(users, by, [F.desc("created_at"), F.col("user_id")], n, offset)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str, ident: Column, check: str) -> DataFrame:
    """Rows whose non-null foreign key has no parent row."""
    missing = child.filter(F.col(key).isNotNull()).join(
        parent.select(F.col(parent_key).alias(key)), key, "left_anti"
    )
    return missing.select(F.lit(check).alias("check"), ident.cast("string").alias("key"), F.col(key).cast("string").alias("detail"))


def foreign_owner(child: DataFrame, parent: DataFrame, key: str, parent_key: str, ident: Column, check: str) -> DataFrame:
    """Rows that point at a parent owned by another user."""
    owner = parent.select(F.col(parent_key).alias(key), F.col("user_id").alias("_owner"))
    return (
        child.join(owner, key)
        .filter(F.col("_owner") != F.col("user_id"))
        .select(F.lit(check).alias("check"), ident.cast("string").alias("key"), F.col("_owner").cast("string").alias("detail"))
    )


def duplicates(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return (
        df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1)
        .select(
            F.lit(check).alias("check"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
            F.col("_n").cast("string").alias("detail"),
        )
    )


def audit(users: DataFrame, subjects: DataFrame, notes: DataFrame, cards: DataFrame) -> DataFrame:
    """Integrity findings as (check, key, detail) over the four study tables."""
    checks = [
        orphans(subjects, users, "user_id", "user_id", F.col("name"), "subject_without_user"),
        orphans(notes, users, "user_id", "user_id", F.col("note_id"), "note_without_user"),
        orphans(cards, notes, "note_id", "note_id", F.col("card_id"), "card_without_note"),
        orphans(cards, users, "user_id", "user_id", F.col("card_id"), "card_without_user"),
        foreign_owner(cards, notes, "note_id", "note_id", F.col("card_id"), "card_on_foreign_note"),
        duplicates(subjects, ["user_id", "name"], "duplicate_subject"),
        duplicates(users, ["email"], "duplicate_email"),
        duplicates(cards, ["external_id"], "duplicate_external_id"),
    ]
    return reduce(DataFrame.unionByName, checks)


def cascade(users: DataFrame, subjects: DataFrame, notes: DataFrame, cards: DataFrame, sessions: DataFrame,
            deleted_users: DataFrame, deleted_subjects: DataFrame) -> DataFrame:
    """What happens when parents are deleted: (table, action, key). Children of a deleted user go
    with it; a note of a deleted subject stays and loses its subject."""
    gone_users = users.join(deleted_users.select("user_id").distinct(), "user_id", "left_semi")
    gone_subjects = subjects.join(gone_users, "user_id", "left_semi").select("subject_id").unionByName(
        deleted_subjects.select("subject_id")
    ).distinct()
    gone_notes = notes.join(gone_users, "user_id", "left_semi")
    orphaned = notes.join(gone_users, "user_id", "left_anti").join(gone_subjects, "subject_id", "left_semi")
    gone_cards = (
        cards.join(gone_notes.select("note_id"), "note_id", "left_semi").select("card_id")
        .unionByName(cards.join(gone_users, "user_id", "left_semi").select("card_id"))
        .distinct()
    )
    gone_sessions = (
        sessions.join(gone_cards, "card_id", "left_semi").select("review_id")
        .unionByName(sessions.join(gone_users, "user_id", "left_semi").select("review_id"))
        .distinct()
    )

    def plan(df: DataFrame, table: str, action: str, key: str) -> DataFrame:
        return df.select(F.lit(table).alias("table"), F.lit(action).alias("action"), F.col(key).cast("string").alias("key"))

    return reduce(DataFrame.unionByName, [
        plan(gone_users, "users", "delete", "user_id"),
        plan(gone_subjects, "subjects", "delete", "subject_id"),
        plan(gone_notes, "notes", "delete", "note_id"),
        plan(orphaned, "notes", "set_null_subject", "note_id"),
        plan(gone_cards, "flashcards", "delete", "card_id"),
        plan(gone_sessions, "study_sessions", "delete", "review_id"),
    ])


def library_search(notes: DataFrame, cards: DataFrame, sessions: DataFrame, query: str = "", kind: str = "all") -> DataFrame:
    """One result over notes (title), cards (question) and sessions (quality, seconds, time):
    case-insensitive containment; an empty query matches everything."""
    needle = query.strip().lower()
    parts = {
        "notes": notes.select(F.lit("note").alias("kind"), F.col("note_id").cast("string").alias("id"), F.col("title").alias("text")),
        "flashcards": cards.select(F.lit("flashcard").alias("kind"), F.col("card_id").cast("string").alias("id"), F.col("question").alias("text")),
        "sessions": sessions.select(
            F.lit("session").alias("kind"), F.col("review_id").cast("string").alias("id"),
            F.concat_ws(
                " ",
                F.coalesce(F.col("quality").cast("string"), F.lit("")),
                F.coalesce(F.col("time_spent").cast("string"), F.lit("")),
                F.coalesce(F.date_format("reviewed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")),
            ).alias("text"),
        ),
    }
    chosen = list(parts.values()) if kind == "all" else [parts[kind]]
    hits = [p.filter(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(needle))) if needle else p for p in chosen]
    return reduce(DataFrame.unionByName, hits)
