"""Study tracking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyspark.operators import study
from studyspark.plans import views as v
from studyspark.plans.registry import Catalog
from studyspark.plans.views import AS_OF, day, stamp, with_views
from studyspark.sources.tables import read_table

catalog = Catalog()

SQL_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
SQL_DAY = "strftime({}, '%Y-%m-%d')"

STEP_SQL = """
  SELECT review_id, quality, reviewed_at,
         CAST(review_id % 4 AS INTEGER) AS rep0,
         CASE review_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 15 END AS int0,
         1.3 + CAST(review_id % 13 AS DOUBLE) / 10 AS ef0
  FROM reviews"""


@catalog.add("h1_sm2_step", with_views("reviews", f""", s AS ({STEP_SQL}),
n AS (SELECT *, CASE WHEN quality >= 3 THEN rep0 + 1 ELSE 0 END AS rep1 FROM s),
i AS (SELECT *, CASE WHEN rep1 <= 1 THEN 1 WHEN rep1 = 2 THEN 6
        WHEN floor(int0 * ef0 + 0.5) = 0 THEN 1 ELSE CAST(floor(int0 * ef0 + 0.5) AS BIGINT) END AS int1 FROM n)
SELECT review_id, CAST(rep1 AS BIGINT) AS repetitions, CAST(int1 AS BIGINT) AS "interval",
       round(greatest(CAST(1.3 AS DOUBLE), ef0 + (CAST(0.1 AS DOUBLE) - (5 - quality) * (CAST(0.08 AS DOUBLE) + (5 - quality) * CAST(0.02 AS DOUBLE)))), 6) AS ef,
       {SQL_DAY.format("CAST(reviewed_at AS DATE) + CAST(int1 AS INTEGER)")} AS due
FROM i"""))
def _(spark, sf):
    state = v.reviews(spark, sf).select(
        "review_id", "quality", "reviewed_at",
        (F.col("review_id") % 4).cast("int").alias("repetitions"),
        F.expr("CASE review_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 6 ELSE 15 END").alias("interval"),
        (F.lit(1.3) + (F.col("review_id") % 13).cast("double") / 10).alias("ef"),
    )
    return study.sm2_review(state).select(
        "review_id", F.col("repetitions").cast("bigint").alias("repetitions"), F.col("interval").cast("bigint").alias("interval"),
        F.round("ef", 6).alias("ef"), day(F.col("next_review_date")).alias("due"),
    )


REPLAY_SQL = """
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, card_id ORDER BY reviewed_at, review_id) AS rn FROM reviews),
f AS (
  SELECT user_id, card_id, CAST(0 AS BIGINT) AS rn, 0 AS rep, CAST(0 AS DOUBLE) AS ivl, CAST(2.5 AS DOUBLE) AS ef,
         CAST(NULL AS TIMESTAMP) AS last_at
  FROM (SELECT DISTINCT user_id, card_id FROM reviews)
  UNION ALL
  SELECT f.user_id, f.card_id, r.rn, CASE WHEN quality >= 3 THEN rep + 1 ELSE 0 END,
         CASE WHEN quality < 3 OR rep = 0 THEN 1 WHEN rep = 1 THEN 6
              WHEN floor(ivl * ef + 0.5) = 0 THEN 1 ELSE floor(ivl * ef + 0.5) END,
         greatest(CAST(1.3 AS DOUBLE), ef + (CAST(0.1 AS DOUBLE) - (5 - quality) * (CAST(0.08 AS DOUBLE) + (5 - quality) * CAST(0.02 AS DOUBLE)))),
         r.reviewed_at
  FROM f JOIN r ON r.user_id = f.user_id AND r.card_id = f.card_id AND r.rn = f.rn + 1
),
state AS (
  SELECT user_id, card_id, CAST(rep AS BIGINT) AS repetitions, CAST(ivl AS BIGINT) AS "interval", round(ef, 6) AS ef, rn AS reviews,
         CAST(last_at AS DATE) + CAST(ivl AS INTEGER) AS due
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, card_id ORDER BY rn DESC) AS k FROM f) WHERE k = 1
)"""


@catalog.add("h2_sm2_replay", with_views("reviews", REPLAY_SQL + f"""
SELECT user_id, card_id, repetitions, "interval", ef, reviews, {SQL_DAY.format("due")} AS due FROM state""", recursive=True))
def _(spark, sf):
    return study.sm2_replay(v.reviews(spark, sf)).select(
        "user_id", "card_id", F.col("repetitions").cast("bigint").alias("repetitions"), F.col("interval").cast("bigint").alias("interval"),
        F.round("ef", 6).alias("ef"), "reviews", day(F.col("next_review_date")).alias("due"),
    )


@catalog.add("h2_due_after_replay", with_views("reviews", REPLAY_SQL + f"""
, q AS (SELECT user_id, card_id, due, row_number() OVER (PARTITION BY user_id ORDER BY due, card_id) AS rk
        FROM state WHERE due <= DATE '2024-02-01')
SELECT user_id, card_id, {SQL_DAY.format("due")} AS due, rk AS "rank" FROM q WHERE rk <= 20""", recursive=True))
def _(spark, sf):
    state = study.sm2_replay(v.reviews(spark, sf))
    return study.due_cards(state, "2024-02-01").select(
        "user_id", "card_id", day(F.col("next_review_date")).alias("due"), F.col("rank").cast("bigint").alias("rank")
    )


@catalog.add("h4_due_cards", with_views("cards", f"""
SELECT user_id, card_id, {SQL_DAY.format("next_review_date")} AS due, rk AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY next_review_date, card_id) AS rk
  FROM cards WHERE next_review_date <= DATE '{AS_OF}') WHERE rk <= 20"""))
def _(spark, sf):
    return study.due_cards(v.cards(spark, sf), AS_OF).select(
        "user_id", "card_id", day(F.col("next_review_date")).alias("due"), F.col("rank").cast("bigint").alias("rank")
    )


@catalog.add("h5_list_cards", with_views("cards", f"""
SELECT 'user' AS by_key, user_id AS id, card_id, {SQL_DAY.format("next_review_date")} AS due, rk AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY next_review_date, card_id) AS rk FROM cards)
WHERE rk > 5 AND rk <= 15
UNION ALL
SELECT 'note', note_id, card_id, {SQL_DAY.format("next_review_date")}, rk FROM (
  SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY next_review_date, card_id) AS rk
  FROM cards WHERE next_review_date <= DATE '{AS_OF}') WHERE rk <= 3"""))
def _(spark, sf):
    cards = v.cards(spark, sf)

    def shape(df, kind, key):
        return df.select(F.lit(kind).alias("by_key"), F.col(key).alias("id"), "card_id",
                         day(F.col("next_review_date")).alias("due"), F.col("rank").cast("bigint").alias("rank"))

    return shape(study.list_cards(cards, "user_id", 10, 5), "user", "user_id").unionByName(
        shape(study.list_cards(cards, "note_id", 3, 0, AS_OF), "note", "note_id")
    )


@catalog.add("h6_study_stats", with_views("users reviews", """
SELECT users.user_id, count(review_id) AS total_reviews, round(coalesce(avg(quality), 0), 6) AS avg_quality,
       CAST(coalesce(sum(time_spent), 0) AS BIGINT) AS total_seconds
FROM users LEFT JOIN (SELECT * FROM reviews WHERE reviewed_at >= TIMESTAMP '2024-01-05' AND reviewed_at <= TIMESTAMP '2024-01-25') r
  ON r.user_id = users.user_id GROUP BY users.user_id"""))
def _(spark, sf):
    return study.study_stats(v.reviews(spark, sf), "2024-01-05", "2024-01-25", v.users(spark, sf)).withColumn(
        "avg_quality", F.round("avg_quality", 6)
    )


@catalog.add("h7_card_stats", with_views("reviews", """
SELECT card_id, count(*) AS reviews, round(avg(quality), 6) AS avg_quality FROM reviews GROUP BY card_id"""))
def _(spark, sf):
    return study.card_stats(v.reviews(spark, sf)).withColumn("avg_quality", F.round("avg_quality", 6))


@catalog.add("h8_list_sessions", with_views("reviews", f"""
SELECT user_id, review_id, {SQL_STAMP.format("reviewed_at")} AS reviewed_at, rk AS "rank", total FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY reviewed_at DESC, review_id DESC) AS rk,
         count(*) OVER (PARTITION BY user_id) AS total
  FROM reviews WHERE reviewed_at >= TIMESTAMP '2024-01-05' AND reviewed_at <= TIMESTAMP '2024-01-25')
WHERE rk > 10 AND rk <= 30"""))
def _(spark, sf):
    return study.list_sessions(v.reviews(spark, sf), "2024-01-05", "2024-01-25", 20, 10).select(
        "user_id", "review_id", stamp(F.col("reviewed_at")).alias("reviewed_at"), F.col("rank").cast("bigint").alias("rank"), "total"
    )


@catalog.add("h9_latest_reviews", with_views("reviews", f"""
SELECT card_id, review_id, quality, {SQL_STAMP.format("reviewed_at")} AS reviewed_at, rk AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY reviewed_at DESC, review_id DESC) AS rk FROM reviews) WHERE rk <= 10"""))
def _(spark, sf):
    return study.latest_reviews(v.reviews(spark, sf)).select(
        "card_id", "review_id", F.col("quality").cast("bigint").alias("quality"),
        stamp(F.col("reviewed_at")).alias("reviewed_at"), F.col("rank").cast("bigint").alias("rank"),
    )


@catalog.add("h10_dashboard", with_views("users notes subjects cards", f"""
, s AS (SELECT user_id, count(*) AS n FROM subjects GROUP BY 1),
t AS (SELECT user_id, count(*) AS n FROM notes GROUP BY 1),
c AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE next_review_date <= DATE '{AS_OF}') AS due FROM cards GROUP BY 1),
r AS (SELECT user_id, string_agg(name, ',' ORDER BY rk) AS names FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, name) AS rk FROM subjects)
      WHERE rk <= 5 GROUP BY 1)
SELECT users.user_id, coalesce(s.n, 0) AS total_subjects, coalesce(t.n, 0) AS total_notes,
       coalesce(c.n, 0) AS total_flashcards, coalesce(c.due, 0) AS due_flashcards, coalesce(r.names, '') AS recent_subjects
FROM users LEFT JOIN s ON s.user_id = users.user_id LEFT JOIN t ON t.user_id = users.user_id
LEFT JOIN c ON c.user_id = users.user_id LEFT JOIN r ON r.user_id = users.user_id"""))
def _(spark, sf):
    return study.dashboard(v.users(spark, sf), v.subjects(spark, sf), v.notes(spark, sf), v.cards(spark, sf), AS_OF).withColumn(
        "recent_subjects", F.array_join("recent_subjects", ",")
    )


@catalog.add("h11_card_dashboard", with_views("cards reviews", f"""
, a AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE next_review_date <= DATE '{AS_OF}') AS due FROM cards GROUP BY 1),
b AS (SELECT user_id, count(*) AS n, avg(quality) AS q FROM reviews GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS total_cards, coalesce(a.due, 0) AS due_cards,
       coalesce(b.n, 0) AS total_reviews, round(coalesce(q, 0), 6) AS avg_quality
FROM a FULL JOIN b ON a.user_id = b.user_id"""))
def _(spark, sf):
    return study.card_dashboard(v.cards(spark, sf), v.reviews(spark, sf), AS_OF).withColumn("avg_quality", F.round("avg_quality", 6))


NATION_NOTES = """, nn AS (SELECT o_orderkey AS note_id, c_nationkey AS subject_id, c_custkey AS chapter_id
                           FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _nation_notes(spark, sf):
    chapters = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("chapter_id"), F.col("c_nationkey").alias("subject_id"), F.col("c_name").alias("name"),
        (F.col("c_custkey") % 7).alias("order_index"), F.col("c_acctbal").alias("created_at"),
    )
    notes = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_custkey").alias("chapter_id"))
    return chapters, notes.join(chapters.select("chapter_id", "subject_id"), "chapter_id")


@catalog.add("h12_subject_rollup", f"""WITH x AS (SELECT 1){NATION_NOTES}
SELECT n_nationkey AS subject_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS chapters,
       (SELECT count(*) FROM nn WHERE subject_id = n_nationkey) AS notes FROM nation""")
def _(spark, sf):
    chapters, notes = _nation_notes(spark, sf)
    subjects = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("subject_id"))
    return study.subject_rollup(subjects, chapters, notes)


@catalog.add("h12_note_rollup", f"""WITH x AS (SELECT 1){NATION_NOTES}
SELECT coalesce(subject_id, -1) AS subject_id, coalesce(chapter_id, -1) AS chapter_id, count(*) AS notes,
       CAST(grouping(subject_id, chapter_id) AS BIGINT) AS level
FROM nn GROUP BY ROLLUP (subject_id, chapter_id)""")
def _(spark, sf):
    _, notes = _nation_notes(spark, sf)
    return study.note_rollup(notes).select(
        F.coalesce("subject_id", F.lit(-1)).alias("subject_id"), F.coalesce("chapter_id", F.lit(-1)).alias("chapter_id"),
        "notes", F.col("level").cast("bigint").alias("level"),
    )


@catalog.add("h13_integrity_audit", with_views("users notes", """
, c AS (SELECT l_orderkey * 10 + l_linenumber AS card_id, CASE WHEN l_orderkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END AS note_id, l_suppkey AS user_id FROM lineitem),
o AS (SELECT * REPLACE (CASE WHEN note_id % 7 = 0 THEN -user_id ELSE user_id END AS user_id) FROM notes)
SELECT 'note_without_user' AS "check", CAST(note_id AS VARCHAR) AS "key", CAST(user_id AS VARCHAR) AS detail
FROM o WHERE user_id NOT IN (SELECT user_id FROM users)
UNION ALL SELECT 'subject_without_user', name, CAST(user_id AS VARCHAR) FROM o WHERE user_id NOT IN (SELECT user_id FROM users)
UNION ALL SELECT 'card_without_note', CAST(card_id AS VARCHAR), CAST(note_id AS VARCHAR) FROM c WHERE note_id NOT IN (SELECT note_id FROM o)
UNION ALL SELECT 'card_without_user', CAST(card_id AS VARCHAR), CAST(user_id AS VARCHAR) FROM c WHERE user_id NOT IN (SELECT user_id FROM users)
UNION ALL SELECT 'card_on_foreign_note', CAST(card_id AS VARCHAR), CAST(o.user_id AS VARCHAR) FROM c JOIN o USING (note_id) WHERE o.user_id <> c.user_id
UNION ALL SELECT 'duplicate_subject', CAST(user_id AS VARCHAR) || '|' || name, CAST(count(*) AS VARCHAR) FROM o GROUP BY user_id, name HAVING count(*) > 1
UNION ALL SELECT 'duplicate_email', email, CAST(count(*) AS VARCHAR) FROM users GROUP BY email HAVING count(*) > 1
UNION ALL SELECT 'duplicate_external_id', CAST(card_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM c GROUP BY card_id HAVING count(*) > 1"""))
def _(spark, sf):
    # The tables are sound, so broken references are derived from them: the owner of every seventh note and the note
    # of every eleventh order's cards don't exist, and the card owner is taken from another key column.
    cards = read_table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("card_id"),
        F.expr("CASE WHEN l_orderkey % 11 = 0 THEN -l_orderkey ELSE l_orderkey END").alias("note_id"), F.col("l_suppkey").alias("user_id"),
    ).withColumn("external_id", F.col("card_id"))
    notes = v.notes(spark, sf).withColumn("user_id", F.expr("CASE WHEN note_id % 7 = 0 THEN -user_id ELSE user_id END"))
    return study.audit(v.users(spark, sf), notes, notes, cards)


@catalog.add("h14_cascade", with_views("users notes subjects cards reviews", """
, gu AS (SELECT user_id FROM users WHERE NOT is_active),
gs AS (SELECT DISTINCT subject_id FROM subjects WHERE user_id IN (SELECT user_id FROM gu) OR name = '1-URGENT'),
gn AS (SELECT note_id FROM notes WHERE user_id IN (SELECT user_id FROM gu)),
gc AS (SELECT DISTINCT card_id FROM cards WHERE note_id IN (SELECT note_id FROM gn) OR user_id IN (SELECT user_id FROM gu)),
gr AS (SELECT DISTINCT review_id FROM reviews WHERE card_id IN (SELECT card_id FROM gc) OR user_id IN (SELECT user_id FROM gu))
SELECT 'users' AS "table", 'delete' AS action, CAST(user_id AS VARCHAR) AS "key" FROM gu
UNION ALL SELECT 'subjects', 'delete', subject_id FROM gs
UNION ALL SELECT 'notes', 'delete', CAST(note_id AS VARCHAR) FROM gn
UNION ALL SELECT 'notes', 'set_null_subject', CAST(note_id AS VARCHAR) FROM notes
  WHERE note_id NOT IN (SELECT note_id FROM gn) AND subject_id IN (SELECT subject_id FROM gs)
UNION ALL SELECT 'flashcards', 'delete', CAST(card_id AS VARCHAR) FROM gc
UNION ALL SELECT 'study_sessions', 'delete', CAST(review_id AS VARCHAR) FROM gr"""))
def _(spark, sf):
    users, subjects = v.users(spark, sf), v.subjects(spark, sf)
    return study.cascade(
        users, subjects, v.notes(spark, sf), v.cards(spark, sf), v.reviews(spark, sf),
        users.filter("NOT is_active"), subjects.filter("name = '1-URGENT'"),
    )


@catalog.add("h15_list_notes", with_views("notes", f"""
SELECT user_id, status, note_id, {SQL_STAMP.format("created_at")} AS created_at, rk AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, status ORDER BY created_at DESC, note_id DESC) AS rk FROM notes) WHERE rk <= 5"""))
def _(spark, sf):
    return study.list_notes(v.notes(spark, sf), ["user_id", "status"], 5).select(
        "user_id", "status", "note_id", stamp(F.col("created_at")).alias("created_at"), F.col("rank").cast("bigint").alias("rank")
    )


@catalog.add("h15_status_queue", with_views("notes", f"""
SELECT status, note_id, {SQL_STAMP.format("created_at")} AS created_at, rk AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at, note_id) AS rk FROM notes) WHERE rk <= 50"""))
def _(spark, sf):
    return study.status_queue(v.notes(spark, sf)).select(
        "status", "note_id", stamp(F.col("created_at")).alias("created_at"), F.col("rank").cast("bigint").alias("rank")
    )


@catalog.add("h15_status_counts", with_views("notes", """
SELECT user_id, count(*) FILTER (WHERE status = 'F') AS f, count(*) FILTER (WHERE status = 'O') AS o,
       count(*) FILTER (WHERE status = 'P') AS p FROM notes GROUP BY user_id"""))
def _(spark, sf):
    return study.status_counts(v.notes(spark, sf), ["F", "O", "P"]).select(
        "user_id", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p")
    )


@catalog.add("h16_list_chapters", """
SELECT subject_id, chapter_id, order_index, rk AS "rank" FROM (
  SELECT c_nationkey AS subject_id, c_custkey AS chapter_id, c_custkey % 7 AS order_index,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7, c_acctbal, c_custkey) AS rk FROM customer) WHERE rk <= 50""")
def _(spark, sf):
    chapters, _ = _nation_notes(spark, sf)
    return study.list_chapters(chapters).select("subject_id", "chapter_id", "order_index", F.col("rank").cast("bigint").alias("rank"))


@catalog.add("h16_list_subjects", with_views("notes subjects", """
SELECT user_id, name, rk AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, name) AS rk FROM subjects) WHERE rk <= 3"""))
def _(spark, sf):
    return study.list_subjects(v.subjects(spark, sf), 3).select("user_id", "name", F.col("rank").cast("bigint").alias("rank"))


@catalog.add("h16_list_users", with_views("users", f"""
SELECT nation, user_id, {SQL_STAMP.format("created_at")} AS created_at, rk AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY nation ORDER BY created_at DESC, user_id) AS rk
  FROM users WHERE is_active AND email_verified) WHERE rk <= 20"""))
def _(spark, sf):
    return study.list_users(v.users(spark, sf), ["nation"], True, True, 20).select(
        "nation", "user_id", stamp(F.col("created_at")).alias("created_at"), F.col("rank").cast("bigint").alias("rank")
    )


@catalog.add("h17_library_search", with_views("notes reviews", """
, lib AS (
  SELECT 'note' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'flashcard', CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'session', CAST(review_id AS VARCHAR),
    CAST(quality AS VARCHAR) || ' ' || CAST(time_spent AS VARCHAR) || ' ' || strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') FROM reviews)
SELECT kind, id, text FROM lib WHERE contains(lower(text), 'an') OR contains(lower(text), '01-0')
  AND NOT contains(lower(text), 'an')"""))
def _(spark, sf):
    notes = read_table(spark, sf, "documents").select(F.col("doc_id").alias("note_id"), F.col("text").alias("title"))
    cards = read_table(spark, sf, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("card_id"), F.col("text").alias("question")
    )
    sessions = v.reviews(spark, sf)
    return study.library_search(notes, cards, sessions, " AN ").unionByName(
        study.library_search(notes, cards, sessions, "01-0").filter("NOT contains(lower(text), 'an')")
    )
