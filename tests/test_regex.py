"""Patterns against the engine whose syntax they follow."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tablecheck.functions import regex

TEXTS = ["", "a", "b", "a\n", "b\n", "\n", "a\nb", "x\x0by", "x\ty", " ", "AB", "ab", "aab", "\u2028",
         "a\n\nb", "\x85", "1.5", "\\", "s", "h"]


@pytest.mark.parametrize("pattern", [
    r"\v", r"^\s$", r"^\S$", r"[\s]y", r"[^\s]$", r"[\S]", r"[\v]", "(?U)a+", "(?U:a+)b", "(?Ui)AB$",
    "(?m:a$)|b$", "(?m)^$", "(?m)^b", "(?m)a$", "((?m)a$)|b$", "(?i)ab", "(?s)a.b", "a.b", "^a$",
    "(?m-s:^a.b$)", "(a(?i)b)|AB", "[[:space:]]", r"\Qa\E", "(?P<n>a)b", "a{0,2}b", "(?i-U:A)b$",
])
def test_the_same_texts_match(spark, pattern):
    con = duckdb.connect()
    expected = [con.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] for t in TEXTS]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    found = frame.select("i", F.col("t").rlike(regex.to_java(pattern)).alias("m")).orderBy("i").collect()
    assert [r.m for r in found] == expected


@pytest.mark.parametrize("pattern", [
    "(?x)a b", "(?d)a", r"\cA", "a{1001}", "a{1,1001}", r"[\h]", r"\h", "(?=a)", "a++", "(?u)a",
])
def test_what_the_engine_refuses_is_refused(pattern):
    with pytest.raises(duckdb.Error):
        duckdb.connect().execute("SELECT regexp_matches('a', ?)", [pattern]).fetchone()
    with pytest.raises(ValueError):
        regex.to_java(pattern)
