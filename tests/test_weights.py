"""Stated weights: what stands left and right of a percentage."""

import pytest

from folium.functions import weights

LINES = {
    "Quizzes            40%": ("row", "Quizzes", 40.0, ""),
    "Essay One   60%  due October 3": ("row", "Essay One", 60.0, "  due October 3"),
    "Final paper 12.5 %": ("line", "Final paper", 12.5, ""),
    "  Field Notes 55%": ("line", "Field Notes", 55.0, ""),
    "The final exam for this course is worth a lot 55%": None,
    "65% - Practice Sets": ("share", "Practice Sets", 65.0, ""),
    "- 35% participation": ("share", "participation", 35.0, ""),
    "94% or greater": None,
    "94% orchestra visits": ("share", "orchestra visits", 94.0, ""),
    "= 70%": ("alone", "", 70.0, ""),
    "70%": ("alone", "", 70.0, ""),
    "Enrolment: 1234%": None,
    "Title: 40%": None,
    "%": None,
    "no weight": None,
    "": None,
}
PROSE = {
    "Policy Memo (50%): five pages. Reading Journal (20 %): weekly.": [(0, 17, "Policy Memo", 50.0, False), (31, 53, "Reading Journal", 20.0, False)],
    "Exams (15% each; 30% total)": [(0, 26, "Exams", 30.0, True)],
    "Lab Work (40% total, as divided below): Part One (20%): x.": [(0, 19, "Lab Work", 40.0, True), (40, 54, "Part One", 20.0, False)],
    "papers (5% per week, 20% total)": [(0, 30, "papers", 20.0, True)],
    "lower case (20%)": [],
    "Some (20%": [],
    "It is 20% of all": [],
    "A (20%)": [],
    "": [],
}


@pytest.mark.parametrize("line", LINES)
def test_lines(line):
    assert weights.stated_in_line(line) == LINES[line]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert weights.stated_in_prose(text) == PROSE[text]


def test_long_texts_are_read_in_one_pass():
    assert len(weights.stated_in_prose("Essay on rule (5%) and then " * 20_000)) == 20_000
    assert weights.stated_in_prose("%" * 200_000) == [] and weights.stated_in_line("x" * 500_000 + " 5%") is not None


def test_columns_hold_null_and_empty_texts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t,) for t in (*LINES, None)], "x string").select("x", weights.in_line(F.col("x")).alias("s"), weights.in_prose(F.col("x")).alias("p")).collect()
    assert {r.x: r.s.shape and tuple(r.s) for r in rows} == LINES | {None: None}
    assert all(r.p == [] for r in rows)
    caps = spark.createDataFrame([("at most five (5) double pages",), ("about 1,500 words",), ("pages",), (None,)], "x string").select(weights.limit(F.col("x"), "page", weights.PAGE_CUES, "[0-9]+|five", 3).alias("p"), weights.limit(F.col("x"), "word", weights.WORD_CUES, "[0-9,]{3,7}", 0).alias("w")).collect()
    assert [tuple(r) for r in caps] == [("five", None), (None, "1,500"), (None, None), (None, None)]
