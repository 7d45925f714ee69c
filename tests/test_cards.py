"""Card and quiz queries on small tables."""


def talk(spark, tmp_path, words):
    """A folder whose conversations each ask once and are answered with one word; all are questions of the mcq kind."""
    rows = [row for i, word in enumerate(words) for row in ((i * 6, 0, "user", "Was?"), (i * 6, 1, "assistant", f"{word} und mehr"))]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


WORDS = ("Beß", "Einß,", "Über", "ŉa", "ﬁn", "abc")


def test_answers_in_capitals_are_right(spark, tmp_path):
    query = __import__("__spark_entry__").queries()["g16_grade"]
    rows = query(spark, talk(spark, tmp_path, WORDS)).collect()
    assert {(r.attempt_id // 6, r.type, r.correct) for r in rows} == {(i, "mcq", True) for i in range(len(WORDS))}


def test_scores_count_answers_in_capitals(spark, tmp_path):
    query = __import__("__spark_entry__").queries()["g17_scores"]
    rows = query(spark, talk(spark, tmp_path, WORDS)).collect()
    assert {(r.attempt_id // 6, r.score, r.max_score, r.correct_answers) for r in rows} == {(i, 1, 1, 1) for i in range(len(WORDS))}
