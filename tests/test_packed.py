import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators.packed import LABEL_ENDINGS, LABEL_WORDS, is_label_line, label_end, label_lines, parse_values, unpack_values
from tests.conftest import rows


def values(text):
    return [v for _, v, _ in parse_values(text)]


def test_delimiters_quotes_and_brackets():
    assert values("Skills: a, b;c | d • e · f，g\th   i / j") == list("abcdefghij")
    assert values('Tools - "x, y", “p; q”, \'r | s\', GIS (raster, vector)') == ["x, y", "p; q", "r | s", "GIS (raster, vector)"]
    assert values('Skills: "the ""red"" ledger, closing", b') == ['the "red" ledger, closing', "b"]
    assert values("Skills: “the \"red\" ledger, closing”, b") == ['the "red" ledger, closing', "b"]
    assert values("Languages: CI/CD, R&D, e-learning, driver's licence") == ["CI/CD", "R&D", "e-learning", "driver's licence"]


def test_blank_items_take_no_position():
    assert parse_values("Skills: a,, b, ,") == [(1, "a", ""), (2, "b", "")]
    assert parse_values("Skills:") == [] and parse_values("") == [] and parse_values(None) == []


def test_malformed_marks_backtrack_and_are_flagged():
    assert parse_values('Skills: "a, b') == [(1, '"a', "bad_quote"), (2, "b", "")]
    assert parse_values("Skills: f (a, b") == [(1, "f (a", "bad_bracket"), (2, "b", "")]
    assert parse_values('Skills: "a"b, c') == [(1, '"a"b', "bad_quote"), (2, "c", "")]


@given(st.lists(st.text(alphabet="abc ,;\"()", min_size=1, max_size=8).map(str.strip).filter(lambda x: x and "  " not in x), max_size=6))
@settings(max_examples=60, deadline=None)
def test_round_trip_of_quoted_values(items):
    line = "Skills: " + "; ".join('"' + x.replace('"', '""') + '"' for x in items)
    assert values(line) == [x.strip() for x in items]


def test_very_long_line_is_read_whole():
    assert len(parse_values("Skills: " + ", ".join(f"s{k}" for k in range(20_000)))) == 20_000
    assert len(parse_values("Skills: " + "(" * 5_000 + ", b")) == 2


def test_lines_of_texts(spark):
    data = [("1", "Name\n  Core skills – a, b\r\n\nLanguages of work: c\nSkills\nExperience 3: d, e", "x"), ("2", None, "y"), ("3", "", "z")]
    df = spark.createDataFrame(data, "id string, raw_text string, line string")
    out = unpack_values(label_lines(df, "id", "raw_text", "f"))
    assert rows(out, "record_id", "line_no", "item_pos", "item") == [("1", 2, 1, "a"), ("1", 2, 2, "b"), ("1", 4, 1, "c")]
    assert unpack_values(label_lines(df.limit(0), "id", "raw_text", "f")).count() == 0


LABELS = [*(f"My {w}:" for w in (*LABEL_WORDS, *LABEL_ENDINGS)), "Skills:", "Frameworks:", "Programming:", "Kenntnisse:", "Compétences :", "Proficient in:", "Sprachkenntnisse –", "Technical and professional skills -", "My main tools:", "Idiomas:", "Outils & logiciels:", "Tools I use daily:",
          "Other IT-skills:", "* Know-how:", "  - Core skills —", "LANGUAGES -x", "IT-Kenntnisse:", "Tools (daily use):"]
NO_LABELS = ["Education:", "Experience 3: skills", "Skills", "skillful:", "Owned the river toolkit at Copper Field Works of Ashby: tuned", "At the firm we kept tools for the whole of the crew:", "Name: Skill Tools", "", ":", "-", "state-of-the-art tools"]


def test_labels_in_other_wordings(spark):
    lines = [(x + " a, b", True) for x in LABELS] + [(x, False) for x in NO_LABELS]
    df = spark.createDataFrame([*lines, (None, False)], "line string, want boolean")
    got = {r["line"]: r["got"] for r in df.select("line", is_label_line(F.col("line")).alias("got")).collect()}
    assert {x: bool(got[x]) for x, _ in lines} == dict(lines)
    for x in LABELS:
        assert values(x + " a, b")[-2:] == ["a", "b"] and label_end(x + " a, b") in (len(x), len(x) - 1) or x == "LANGUAGES -x"


def test_a_line_of_any_length_is_tested_at_once(spark):
    long = ["a" * 60_000 + " skill x", " " * 60_000 + "skill x: a", "a-" * 30_000 + "skill: x", "and " * 15_000 + "skills: x", "skills " * 9_000 + ": x", "-" * 60_000]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(long)], "k int, line string").repartition(1)
    df.select(is_label_line(F.col("line"))).collect()
    start = time.time()
    got = [r["got"] for r in df.orderBy("k").select(is_label_line(F.col("line")).alias("got")).collect()]
    ends = [label_end(x) for x in long]
    assert time.time() - start < 2 and got == [False, True, False, False, False, False] and ends[1] == 60_008
