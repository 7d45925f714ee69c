"""Flashcards and quizzes. Questions and answers of a chunk are built inside the chunk's row; only the
removal of similar questions needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.functions.text import bind, contains_any, replace_all, strip, word_count
from studyspark.operators.edit_join import leader_clusters, similar_within
from studyspark.operators.paging import top_n

VARIANTS = ("heuristic", "templates")
MIN_CHUNK = 50          # the template generator skips shorter chunks
PER_CHUNK = 3           # questions asked of a chunk unless an argument says otherwise


def _check(variant: str) -> None:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")


def _templates(variant: str, kind: str, n: int | None = None) -> Column:
    table = fx.HEURISTIC_TEMPLATES if variant == "heuristic" else fx.PLAIN_TEMPLATES
    return F.array(*[F.lit(text) for k, text in table if k == kind][:n])


def _only(condition: Column, templates: Column) -> Column:
    return F.when(condition, templates).otherwise(F.array().cast("array<string>"))


def select_templates(chunks: DataFrame, variant: str = "heuristic", seed: int = 42, per_chunk: int = PER_CHUNK) -> DataFrame:
    """Chunks with up to ``per_chunk`` question templates. The heuristic variant takes the first that apply, the
    other one draws by the least digest of chunk, template and seed."""
    _check(variant)
    entities = F.size("entities")
    level, kind = F.col("academic_level"), F.col("type")
    if variant == "heuristic":
        chosen = F.concat(
            _only(F.col("has_formula"), _templates(variant, "formula", 2)),
            _only(entities >= 2, _templates(variant, "difference", 1)),
            _only((level == "advanced") & (kind == "paragraph"), _templates(variant, "why_how", 1)),
            _only(kind.isin("paragraph", "heading"), _templates(variant, "application", 1)),
        )
        picked = F.when(F.size(chosen) > 0, chosen).otherwise(_templates(variant, "definition", 2))
        return chunks.withColumn("templates", F.slice(F.array_distinct(picked), 1, per_chunk))
    chosen = F.concat(
        _templates(variant, "definition"),
        _only(F.col("has_formula"), _templates(variant, "formula")),
        _only(level.isin("intermediate", "advanced"), _templates(variant, "why_how")),
        _only(entities >= 2, _templates(variant, "difference")),
        _only(level == "advanced", _templates(variant, "application")),
    )
    place = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"))
    drawn = F.array_sort(F.transform(
        chosen, lambda x: F.struct(F.md5(F.concat_ws("|", place, x, F.lit(str(seed)))).alias("k"), x.alias("t"))
    ))
    return chunks.withColumn("templates", F.transform(F.slice(drawn, 1, per_chunk), lambda x: x["t"]))


def _fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def fill_questions(df: DataFrame, variant: str = "heuristic") -> DataFrame:
    """One row per question whose placeholders could all be filled, numbered by its template."""
    _check(variant)
    texts = F.transform("entities", lambda e: e["text"])
    if variant == "heuristic":
        texts = F.filter(texts, lambda x: ~F.lower(x).isin(*fx.QUESTION_STOP_WORDS) & (F.length(x) > 2))
    first, second = F.get(texts, F.lit(0)), F.get(texts, F.lit(1))
    topic = F.coalesce("topic", F.lit("this topic" if variant == "heuristic" else "the concept"))
    base = df.withColumn("_e1", first).withColumn("_e2", second).withColumn("_topic", topic)
    e1, e2, t = F.col("_e1"), F.col("_e2"), F.col("_topic")

    def question(x: Column) -> Column:
        both = _fill(x, {"entity1": e1, "entity2": e2})
        if variant == "heuristic":
            one = _fill(x, {"entity": e1})
            named = F.coalesce(e1, t)
            other = _fill(x, {"topic": t, "process": t, "phenomenon": t, "relationship": t, "concept": named, "principle": named, "method": named})
        else:
            one = _fill(x, {"entity": F.coalesce(e1, t)})
            other = x
        return F.when(F.contains(x, F.lit("{entity1}")), both).when(F.contains(x, F.lit("{entity}")), one).otherwise(other)

    return (
        base.select("*", F.posexplode("templates").alias("q_no", "template"))
        .withColumn("question", question(F.col("template")))
        .filter(F.col("question").isNotNull() & ~F.rlike("question", F.lit(r"[{}]")))
        .drop("templates", "template", "_e1", "_e2", "_topic")
    )


def is_valid_question(q: Column) -> Column:
    return F.length(q).between(5, 200) & ~F.rlike(q, F.lit(r"[{}]")) & (F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit(""))) == 1)


def valid_question(df: DataFrame) -> DataFrame:
    return df.filter(is_valid_question(F.col("question")))


def is_valid_answer(a: Column, variant: str) -> Column:
    if variant == "templates":
        return F.length(a).between(10, 500) & ~F.rlike(a, F.lit(r"[{}]"))
    bare = (word_count(a) == 1) & ~F.rlike(a, F.lit("[=+→]"))
    return F.length(a).between(10, 200) & F.rlike(a, F.lit("[a-zA-Z]")) & ~bare


def valid_answer(df: DataFrame, variant: str = "heuristic") -> DataFrame:
    return df.filter(is_valid_answer(F.col("answer"), variant))


def _nothing() -> Column:
    return F.lit(None).cast("struct<answer:string,confidence:double>")


def _once(value: Column, test) -> Column:
    """A row for the value if it passes the test, else none. Unlike those of a filter, which Spark moves below the
    projection, the value is computed once."""
    return F.explode(F.filter(F.array(value), test))


def answer_overlap(df: DataFrame) -> DataFrame:
    """The sentence that holds most keywords of the question, the first of equals; rows without one are dropped."""
    keep = F.filter(
        F.split(strip(F.lower("question")), f"[{fx.SPACE_CLASS}]+"),
        lambda w: (F.length(w) > 3) & ~w.isin("what", "does", "how", "why"),
    )
    parts = F.filter(F.transform(F.split("text", "[.!?]+"), strip), lambda s: F.length(s) >= 20)
    base = df.withColumn("_kw", keep).withColumn("_n", F.size("_kw"))
    scored = F.transform(parts, lambda s, i: F.struct(
        bind(F.lower(s), lambda low: F.size(F.filter("_kw", lambda k: F.contains(low, k)))).alias("score"), (-i).alias("at"), s.alias("s")
    ))
    best = base.select("*", _once(F.array_max(scored), lambda b: b["score"] > 0).alias("_b"))
    return (
        best.withColumn("answer", F.col("_b.s"))
        .withColumn("confidence", F.least(F.lit(0.7), F.col("_b.score") / F.col("_n")))
        .filter(is_valid_answer(F.col("answer"), "templates"))
        .drop("_kw", "_n", "_b")
    )


def answer_pattern(df: DataFrame) -> DataFrame:
    """Answer by the kind of question: a sentence that names the subject, a causal sentence, a formula, else the
    first sentence; rows where none is valid are dropped."""
    q = F.lower("question")
    subject = strip(F.replace(F.replace(F.replace("question", F.lit("What is"), F.lit("")), F.lit("Define"), F.lit("")), F.lit("?"), F.lit("")))
    base = (
        df.withColumn("_q", q).withColumn("_subject", F.lower(subject))
        .withColumn("_s", F.transform(F.split("text", r"\."), strip))
    )

    def pick(condition: Column, test) -> Column:
        hit = F.get(F.filter("_s", lambda s: test(F.lower(s)) & is_valid_answer(s, "heuristic")), F.lit(0))
        return F.when(condition, bind(hit, lambda h: F.when(h.isNotNull(), F.struct(h.alias("answer"), F.lit(0.6).alias("confidence")))))

    def single(condition: Column, value: Column) -> Column:
        return F.when(condition, bind(value, lambda v: F.when(is_valid_answer(v, "heuristic"), F.struct(v.alias("answer"), F.lit(0.5).alias("confidence")))))

    formula = strip(F.regexp_extract("text", fx.ANSWER_FORMULA, 0))
    found = F.coalesce(
        pick(F.startswith("_q", F.lit("what is")), lambda s: F.contains(s, F.col("_subject"))),
        pick(contains_any(F.col("_q"), ("why", "how", "what causes")), lambda s: contains_any(s, fx.CAUSAL_PHRASES)),
        single(contains_any(F.col("_q"), ("formula", "equation")), formula),
        single(F.lit(True), F.get("_s", F.lit(0))),
        _nothing(),
    )
    return (
        base.select("*", _once(found, lambda a: a.isNotNull()).alias("_a"))
        .withColumn("answer", F.col("_a.answer")).withColumn("confidence", F.col("_a.confidence")).drop("_q", "_subject", "_s", "_a")
    )


def difficulty(df: DataFrame, variant: str = "heuristic") -> DataFrame:
    """0..5 from level, formula and number of entities."""
    _check(variant)
    base = F.lit(2)
    for level, value in fx.LEVEL_DIFFICULTY:
        base = F.when(F.col("academic_level") == level, value).otherwise(base)
    many = F.size("entities") >= 5 if variant == "heuristic" else F.size("entities") > 2
    return df.withColumn("difficulty", F.least(F.lit(5), base + F.col("has_formula").cast("int") + many.cast("int")))


def source_type(df: DataFrame, variant: str = "heuristic") -> DataFrame:
    bar = 0.6 if variant == "heuristic" else 0.75
    return df.withColumn("source_type", F.when(F.col("confidence") > bar, "qa_extracted").otherwise("rule_based"))


def normal_question(q: Column, variant: str = "heuristic") -> Column:
    drop = "[?!.,;:]" if variant == "heuristic" else rf"[^\p{{L}}\p{{N}}_{fx.SPACE_CLASS}]"
    return strip(replace_all(replace_all(F.lower(q), drop), f"[{fx.SPACE_CLASS}]+", " "))


def similar_questions(cards: DataFrame, variant: str = "heuristic", threshold: float = 0.8) -> DataFrame:
    keys = cards.select(normal_question(F.col("question"), variant).alias("s")).distinct()
    return similar_within(keys, threshold)


def dedup_cards(cards: DataFrame, keep: str = "first", variant: str = "heuristic", threshold: float = 0.8, groups: DataFrame | None = None) -> DataFrame:
    """One card per group of similar questions: the group's first card, or the one with the longest answer.
    Cards carry ``ord``, a struct that starts with a number. Equal questions are merged before any
    comparison, so copies cost one aggregation. ``groups`` are the ``question_groups`` where they are known."""
    if keep not in ("first", "longest"):
        raise ValueError("keep must be 'first' or 'longest'")
    if groups is None:
        groups = question_groups(cards, variant, threshold)
    keyed = cards.withColumn("s", normal_question(F.col("question"), variant))
    rank = F.struct(F.col("ord")) if keep == "first" else F.struct(-F.length("answer"), F.col("ord"))
    # Only the order of a card travels through the groups; the cards themselves join at the end.
    best = keyed.select("s", rank.alias("_r"), "ord").join(groups, "s").groupBy("leader").agg(F.min_by("ord", "_r").alias("ord"))
    return cards.join(best.select("ord"), "ord", "left_semi")


def question_groups(cards: DataFrame, variant: str = "heuristic", threshold: float = 0.8) -> DataFrame:
    """s, leader: every different question in its normal form with that which leads its group of similar ones."""
    keyed = cards.select("ord", normal_question(F.col("question"), variant).alias("s"))
    lead = cards.schema["ord"].dataType.names[0]
    return leader_clusters(keyed.groupBy("s").agg(F.min("ord").alias("ord")).withColumn("lead", F.col(f"ord.{lead}")), threshold)


def generate_cards(chunks: DataFrame, variant: str = "heuristic", seed: int = 42) -> DataFrame:
    """Cards of every chunk before deduplication, with their order."""
    _check(variant)
    if variant == "templates":
        chunks = chunks.filter(F.length(strip(F.col("text"))) >= MIN_CHUNK)
    asked = fill_questions(select_templates(chunks, variant, seed), variant)
    answered = answer_pattern(asked) if variant == "heuristic" else answer_overlap(valid_question(asked))
    return source_type(difficulty(answered, variant), variant).select(
        F.struct("doc_id", "chunk_no", "q_no").alias("ord"), "doc_id", "chunk_no", "q_no", "question", "answer",
        F.col("topic").alias("context"), "difficulty", "source_type", "confidence",
    )


def generate_deck(chunks: DataFrame, variant: str = "heuristic", seed: int = 42) -> DataFrame:
    return dedup_cards(generate_cards(chunks, variant, seed), "first" if variant == "heuristic" else "longest", variant)


def map_difficulty(text: Column, words: int = 8) -> Column:
    """Difficulty words or digits to 0..5."""
    t = F.lower(strip(text))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", 0)
        .when(F.rlike(t, F.lit("^[0-9]+$")), F.least(F.lit(5), F.coalesce(t.try_cast("int"), F.lit(5))))
        .when(F.contains(t, F.lit("easy")), 1).when(F.contains(t, F.lit("hard")), 5)
        .when(contains_any(t, ("medium", "moderate")), 3)
        .when(word_count(t) < words, 1).otherwise(3)
    )


def cards_from_questions(questions: DataFrame) -> DataFrame:
    """Cards out of exploded parsed questions."""
    return questions.select(
        "note_id", "pos", "question", "answer", map_difficulty(F.col("difficulty")).alias("difficulty"), "context",
        F.lit("parsed_question").alias("source_type"),
    )


def assemble_deck(extracted: DataFrame, generated: DataFrame, low: int = 0, high: int = 5, count: int | None = None, seed: int = 42) -> DataFrame:
    """Both kinds of cards per note within the difficulty range, in a seeded shuffle order (``shuffle_key``). Given a
    ``count``, at most that many. Cards are (note_id, card_id, difficulty, source_type, ..)."""
    every = extracted.unionByName(generated).filter(F.col("difficulty").between(low, high)).withColumn(
        "shuffle_key", F.md5(F.concat_ws("|", F.col("card_id").cast("string"), F.lit(str(seed))))
    )
    if count is None:
        return every
    return top_n(every, ["note_id"], [F.col("shuffle_key"), F.col("card_id")], count)


def cards_wanted(extracted: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """How many cards a note should get when no count is asked for: as many as it has questions, within the bounds given."""
    wanted = F.greatest(F.lit(least), F.count("*"))
    return extracted.groupBy("note_id").agg(
        (wanted if most is None else F.least(F.lit(most), wanted)).cast("bigint").alias("cards_wanted")
    )


def deck_stats(cards: DataFrame) -> DataFrame:
    """kind, value, n: cards by source and by difficulty."""
    pairs = F.explode(F.array(
        F.struct(F.lit("source_type").alias("kind"), F.col("source_type").alias("value")),
        F.struct(F.lit("difficulty").alias("kind"), F.col("difficulty").cast("string").alias("value")),
    ))
    return cards.select(pairs.alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def quiz_type(raw: Column) -> Column:
    return F.when(raw.isin("mcq", "MCQ"), "mcq").when(raw.isin("true_false", "TRUE_FALSE", "tf"), "true_false").otherwise("short_answer")


def normalize_quiz(quizzes: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions (quiz_id, idx, ..) with known types and difficulties, the first ``limit`` of a quiz if given, and the total points.
    Quizzes are (quiz_id, questions array)."""
    rows = quizzes.select("quiz_id", F.posexplode("questions" if limit is None else F.slice("questions", 1, limit)).alias("idx", "x")).select(
        "quiz_id", "idx", F.col("x.question").alias("question"), quiz_type(F.col("x.type")).alias("type"),
        F.col("x.correct_answer").alias("correct_answer"),
        F.when(F.col("x.difficulty").isin("easy", "medium", "hard"), F.col("x.difficulty")).otherwise("medium").alias("difficulty"),
        F.coalesce("x.points", F.lit(1)).alias("points"),
    )
    return rows, rows.groupBy("quiz_id").agg(F.sum("points").alias("total_points"), F.count("*").alias("question_count"))


def _truth(answer: Column) -> Column:
    return F.when(answer.isin("t", "y"), "true").when(answer.isin("f", "n"), "false").otherwise(answer)


def grade(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """attempt_id, quiz_id, idx, correct, points_earned, points for every question of every attempted quiz. A missing
    answer is wrong. Questions are (quiz_id, idx, type, correct_answer, points), answers (attempt_id, quiz_id, idx, answer)."""
    attempts = answers.select("attempt_id", "quiz_id").distinct()
    paired = attempts.join(questions, "quiz_id").join(answers, ["attempt_id", "quiz_id", "idx"], "left")
    ua, ca = F.lower(strip(F.col("answer"))), F.lower(strip(F.col("correct_answer")))
    words = F.filter(F.split(ca, f"[{fx.SPACE_CLASS}]+"), lambda w: F.length(w) > 2)
    correct = (
        F.when(F.col("type") == "mcq", ua == ca)
        .when(F.col("type") == "true_false", _truth(ua) == _truth(ca))
        .otherwise(F.exists(words, lambda w: F.contains(ua, w)))
    )
    graded = paired.withColumn("correct", F.coalesce(correct, F.lit(False)))
    return graded.withColumn("points_earned", F.when(F.col("correct"), F.col("points")).otherwise(0))


def scores(graded: DataFrame) -> DataFrame:
    return graded.groupBy("attempt_id").agg(
        F.sum("points_earned").alias("score"), F.sum("points").alias("max_score"), F.count_if("correct").alias("correct_answers")
    )
