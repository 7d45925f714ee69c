"""Readers end to end."""

from studyspark.schemas import STUDY_TABLES
from studyspark.session import scratch_path
from studyspark.sources import tables


def test_a_text_corpus_is_one_row_per_file(spark, tmp_path):
    for name, text in (("a.txt", "one\ntwo"), ("b.txt", ""), ("c.txt", "# Title\n")):
        (tmp_path / name).write_text(text)
    rows = {r.doc_id.rsplit("/", 1)[1]: (r.text, r.fmt) for r in tables.read_corpus(spark, str(tmp_path), "markdown").collect()}
    assert rows["a.txt"] == ("one\ntwo", "markdown") and rows["c.txt"] == ("# Title\n", "markdown")


def test_study_tables_come_with_their_schemas(spark):
    folder = scratch_path(spark, "study")
    for name, schema in STUDY_TABLES.items():
        spark.createDataFrame([], schema).write.json(f"{folder}/{name}.json")
    found = tables.read_study_tables(spark, folder, "json")
    assert set(found) == set(STUDY_TABLES) and all(df.count() == 0 and df.columns == [f.split()[0] for f in STUDY_TABLES[n].split(", ")] for n, df in found.items())


def test_notes_parsed_before_give_the_same_item_tables(spark):
    from studyspark.sources.parsed import explode_parsed, parse_content
    text = '{"topics": [{"name": "T", "subtopics": [{"title": "S", "content": "c"}]}], "formulas": [{"expression": "x"}], "key_concepts": [{"label": "K"}]}'
    notes = spark.createDataFrame([(1, text), (2, "{}"), (3, None)], "note_id long, parsed_content string")
    want, got = explode_parsed(notes), explode_parsed(parse_content(notes))
    assert {k: v.collect() for k, v in got.items()} == {k: v.collect() for k, v in want.items()} and got["formulas"].first().latex == "x"
