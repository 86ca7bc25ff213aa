from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as s
from pyspark.sql import functions as F

from evalframe.functions import grading
from evalframe.functions import text as t
from evalframe.plans import fixtures


def test_fixture(spark):
    rows = fixtures.graded(spark)
    args = (F.col("text"), F.col("kind"), F.col("gold"), F.col("choices"))
    got = rows.select("*", grading.grade(*args).alias("g"), grading.grade(*args, strict=True).alias("s")).collect()
    for r in got:
        assert (r.g.parsed, r.g.source, r.g.correct, r.g.confidence) == (r.parsed, r.source, r.correct, r.confidence), r.text
        assert (r.s.parsed, r.s.source) == (r.strict_parsed, r.strict_source), r.text


def test_names_with_accents_are_words(spark):
    df = spark.createDataFrame([("ANSWER: Tomás, Maria", "set", "Maria, Tomás", None), ("ANSWER: José.", "choice", "José", ["Jos", "José"]), ("no, Josés", "choice", "José", ["José"])], "text string, kind string, gold string, choices array<string>")
    got = df.select(grading.grade(F.col("text"), F.col("kind"), F.col("gold"), F.col("choices")).alias("g")).select("g.*").collect()
    assert [(r.parsed, r.correct) for r in got] == [("maria,tomás", True), ("José", True), (None, False)]


def test_choices_are_taken_literally(spark):
    df = spark.createDataFrame([("ANSWER: it is a.c+", ["abc", "a.c+"])], "text string, choices array<string>")
    assert df.select(t.first_choice(F.col("text"), F.col("choices")).alias("c"), t.last_choice(F.col("text"), F.col("choices")).alias("l")).first() == (None, None)  # a plus ends no word
    df = spark.createDataFrame([("x b.c then b.c a", ["bxc", "b.c", "a"])], "text string, choices array<string>")
    assert df.select(t.first_choice(F.col("text"), F.col("choices")).alias("c"), t.last_choice(F.col("text"), F.col("choices")).alias("l")).first() == ("b.c", "a")


def test_null_text(spark):
    df = spark.createDataFrame([(None, "int", "1", None), (None, "set", "", None), (None, "choice", None, None)], "text string, kind string, gold string, choices array<string>")
    got = df.select(grading.grade(F.col("text"), F.col("kind"), F.col("gold"), F.col("choices")).alias("g")).select("g.*").collect()
    assert [(r.parsed, r.source, r.confidence) for r in got] == [(None, "none", None)] * 3


def reference_int(text: str, last: bool) -> str | None:
    found = re.findall(r"-?[0-9]+", text.replace(",", ""))
    return str(int(found[-1 if last else 0])) if found else None


@settings(max_examples=20, deadline=None)
@given(s.lists(s.text(alphabet="0123456789-, ax\n", max_size=40), min_size=1, max_size=20))
def test_integers_as_python_reads_them(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in df.select("text", t.first_int(F.col("text")).alias("a"), t.last_int(F.col("text")).alias("b")).collect():
        assert (r.a, r.b) == (reference_int(r.text, False), reference_int(r.text, True))


@pytest.mark.parametrize(("seconds", "want"), [(0, "0:00"), (61, "1:01"), (3600, "1:00:00"), (36061, "10:01:01")])
def test_duration(spark, seconds, want):
    assert spark.range(1).select(t.duration(F.lit(seconds)).alias("d")).first().d == want


def test_quoting_as_in_messages(spark):
    values = ["a", "it's", 'say "x"', "both ' and \"", None]
    df = spark.createDataFrame([(x,) for x in values], "v string")
    assert [r.q for r in df.select(t.quoted(F.col("v")).alias("q")).collect()] == [repr(x) for x in values]


@settings(max_examples=25, deadline=None)
@given(s.lists(s.tuples(s.text(alphabet="abAB _-é+.\n", max_size=30), s.lists(s.text(alphabet="abAé +", min_size=0, max_size=4), max_size=4)), min_size=1, max_size=40))
def test_choices_as_patterns_find_them(spark, rows):
    df = spark.createDataFrame(rows, "text string, choices array<string>")
    for r in df.select("text", "choices", t.first_choice(F.col("text"), F.col("choices")).alias("first"), t.last_choice(F.col("text"), F.col("choices")).alias("last")).collect():
        places = [[m.start() for m in re.finditer(rf"(?=\b{re.escape(c.lower())}\b)", r.text.lower())] for c in r.choices]
        found = [(p[-1], -i) for i, p in enumerate(places) if p]
        assert r.first == next((c for c, p in zip(r.choices, places, strict=True) if p), None)
        assert r["last"] == (r.choices[-max(found)[1]] if found else None)


@settings(max_examples=20, deadline=None)
@given(s.lists(s.text(alphabet="ab  ,;'\".\nnoeé", max_size=25), min_size=1, max_size=40))
def test_names_as_python_splits_them(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in df.select("text", t.split_names(F.col("text")).alias("n")).collect():
        want = [x for x in (re.sub(r"^\s+|\s+\Z", "", p).strip("'\".").lower() for p in re.split(r"[,;]|\band\b|\bor\b", r.text)) if x]
        assert r.n == ([] if {"none", "no", "nothing", "n/a"} & set(want) else want)


def test_strict_is_read_off_lenient(spark):
    args = (F.col("text"), F.col("kind"), F.col("choices"))
    rows = fixtures.graded(spark).select(grading.parse(*args, strict=True).alias("s"), grading.strictly(grading.parse(*args)).alias("d")).collect()
    assert rows and all(r.s == r.d for r in rows)
