import unicodedata

import pytest
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.functions import mentions
from studyspark.functions import text as t
from studyspark.operators import cards as card_ops
from studyspark.operators import layout, ocr, text_prep


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [
    ("Hello  world\n\n\n  text", "Hello world\n\n text"),
    ("a\r\nb \t c   \n", "a\nb c\n"),
    ("&lt;b&gt; &amp;nbsp; \x07x", "<b> &nbsp; x"),
    ("E = mc²", "E = mc²"),
])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, t.clean_text) == want


def test_clean_without_marks(spark):
    out = one(spark, "## Title\n- item\nF = ma $x+y$", lambda c: t.clean_text(c, False, False))
    assert out == "Title\nitem\nF  ma "


def test_strip_markdown_keeps_fenced_code(spark):
    raw = "**bold** and _it_ [link](http://x)\n```\n**code**\n```\nend *x*"
    assert one(spark, raw, t.strip_markdown) == "bold and it link\n```\n**code**\n```\nend x"


def test_unclosed_fence_is_prose(spark):
    assert one(spark, "```\n**a**", t.strip_markdown) == "```\na"


def test_clean_pdf(spark):
    raw = "INTRO\nPhoto-\nsynthesis is a process.\n\nPage 3\n 12 \nab\nPlants use light."
    assert one(spark, raw, t.clean_pdf) == "Photosynthesis is a process.\nPlants use light."


@pytest.mark.parametrize("raw, kind", [
    ("# Introduction", "heading"), ("Cell Biology", "heading"), ("F = ma", "heading"), ("the force f = ma is known.", "formula"),
    ("- first item in a list that is not upper case.", "list"), ("1. step one of the long list, done properly.", "list"),
    ("a well-known fact about plants.", "paragraph"), ("", "unknown"),
])
def test_content_type(spark, raw, kind):
    assert one(spark, raw, t.content_type) == kind


@pytest.mark.parametrize("raw, flag", [
    ("x-y", True), ("well-known", False), ("a-2", True), ("CO2", True), ("H₂", True), ("$x$", True), ("plain text", False), ("mc²", False), ("mc⁴", True),
])
def test_has_formula(spark, raw, flag):
    assert one(spark, raw, t.has_formula) is flag


def test_chunks_stay_below_the_limit_and_lose_no_word(spark):
    raw = "Short one.\n\n" + " ".join(f"Sentence number {i} has, well, some words; indeed." for i in range(60)) + "\n\n" + "x" * 1300 + ", " + "y " * 400
    for size in (80, 200, 500):
        chunks = one(spark, raw, lambda c: t.chunk_array(c, size))
        assert chunks and max(map(len, chunks)) <= size
        assert "".join("".join(chunks).split()) == "".join(raw.split())
    assert one(spark, " \n\n\t ", t.chunk_array) == []


def test_topic_is_carried_from_headings(spark):
    rows = [(1, 0, "Photosynthesis"), (1, 1, "the " + "long " * 30 + "text."), (1, 2, "and x = y " * 12), (1, 3, "more " * 30)]
    df = text_prep.propagate_topic(text_prep.chunk_metadata(spark.createDataFrame(rows, "doc_id int, chunk_no int, text string")))
    assert [r.topic for r in df.orderBy("chunk_no").collect()] == ["Photosynthesis"] * 4


def test_layout_of_recognised_text(spark):
    raw = "BIOLOGY NOTES\n* one\n* two\n| a | b |\n|---|---|\nEnergy is $E=mc^2$ here and it continues for quite a while in lower case\n```py\nx = 1\n```\nshort tail"
    lines = layout.classify_lines(spark.createDataFrame([(1, raw)], "doc_id int, text string"))
    kinds = [r.kind for r in lines.orderBy("line_no").collect()]
    assert kinds == ["heading", "list", "list", "table", "table", "math", "fence_open", "code", "fence_close", "paragraph"]
    blocks = layout.blocks(lines).orderBy("block_no").collect()
    assert [b.type for b in blocks] == ["list", "table", "math", "paragraph", "code", "paragraph"]
    assert list(blocks[0]["items"]) == ["one", "two"] and blocks[4].text == "```py\nx = 1"
    flat = layout.flatten_blocks(layout.blocks(lines), layout.sections(lines)).first().text
    assert flat.startswith("BIOLOGY NOTES\n- one\n- two\n| a | b |")


def test_select_ocr_chain(spark):
    rows = [
        (1, "pixtral", "a", 0.92, None), (1, "trocr", "b", 0.99, None),
        (2, "pixtral", "a", 0.5, None), (2, "trocr", "b", 0.6, None), (2, "textract", "c", 0.65, None),
        (3, "pixtral", None, None, "boom"), (3, "trocr", None, None, "boom"),
    ]
    out = {r.note_id: r for r in ocr.select_ocr(spark.createDataFrame(rows, "note_id int, service string, text string, confidence double, error string")).collect()}
    assert (out[1].service, list(out[1].chain)) == ("pixtral", ["pixtral"])
    assert (out[2].service, list(out[2].chain)) == ("textract", ["pixtral", "trocr", "textract"])
    assert (out[3].service, list(out[3].chain)) == (None, ["pixtral_failed", "trocr_failed", "textract_unavailable"])


def test_formula_and_mentions_are_computed_once(spark):
    """One scan for the formula mark, one answer per question: no copies of them in the plan."""
    chunks = spark.createDataFrame([(1, 0, "Law = law. The law holds because the law is law.", "Law", "Why does law hold?")], "doc_id long, chunk_no int, text string, topic string, question string")
    plan = text_prep.chunk_metadata(chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[=+/×÷]") == 1
    plan = card_ops.answer_overlap(chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max(") == 1


def test_formula_mark_and_mentions_of_odd_texts(spark):
    texts = ["A-1", "x1-2", "a-b\n", "é-b", "1-2é", "xCO2", "CO2", "a$b", "a$b$", "\\left", "_a-b", "a-bc", "x⁵", "ⁱ", "a→b", "𝐀O2", "𝐚Bc Éa", "😀Bc iPhone X-Y 9Abc aBC",
             "theorem Theorem THEOREM b", "Method method A = B a=b=c x = ", "Law law LAW Law-x", "D'E'- Ab Cd eF", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", t.has_formula(F.col("text")).alias("f"), F.rlike("text", F.lit(fx.FORMULA_MARK)).alias("mark"),
        mentions.mention_array(F.col("text")).alias("m"), F.regexp_extract_all("text", F.lit(mentions.CANDIDATE), F.lit(0)).alias("every")).collect()
    for row in rows:
        assert row.f == row.mark, row.text
        kept, seen = [], set()
        for x in row.every or []:
            wanted = unicodedata.category(x[0]) == "Lu" or any(s in x for s in "=+×÷→⇒±") or any(k in x.lower() for k in fx.ACADEMIC_KEYWORDS)
            if wanted and x.lower() not in seen:
                seen.add(x.lower())
                kept.append(x)
        assert row.m == (None if row.text is None else kept), row.text
