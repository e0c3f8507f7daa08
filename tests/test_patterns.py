import random
import re

import pytest

from tablecheck.operators import patterns
from tablecheck.operators.patterns import accepted, learned_patterns
from tablecheck.plans.suggestions import suggest_checks


def found(df, columns=None):
    out = {}
    for r in learned_patterns(df, columns).collect():
        out.setdefault(r.column_name, []).append((r.pattern, r.n_values))
    return {c: sorted(p, key=lambda x: (-x[1], x[0])) for c, p in out.items()}


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_every_value_follows_a_pattern_and_is_counted_once(spark):
    rng = random.Random(4)
    odd = ["", " ", "a", "A.b*c+(d)[e]{f}^g$|\\", "x\ny", "ünï 漢字", "é", "\x01", "a" * 300, "9" * 2000, "tab\tx", "A1b2"]
    many = ["".join(rng.choice("abAB01 -_.é") for _ in range(rng.randint(0, 14))) for _ in range(400)]
    values = odd * 3 + many + [None]
    patterns = found(frame(spark, values).repartition(5))["v"]
    for v in values[:-1]:
        assert any(re.search(p[:-1] + r"\Z", v) for p, _ in patterns), (v, patterns)
    assert sum(n for _, n in patterns) == len(values) - 1


def test_plain_patterns_of_several_columns(spark):
    rows = [(f"Order-{i:05d}", "same", f"{i % 90 + 10}.{i % 7}", "") for i in range(500)]
    got = found(spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(3))
    assert got == {
        "a": [("^Order-[0-9]{5}$", 500)], "b": [("^same$", 500)],
        "c": [(r"^[0-9]{2}\.[0-9]$", 500)], "d": [("^$", 500)],
    }


def test_a_few_bad_values_have_patterns_of_their_own(spark):
    values = [f"Part-{i:04d}" for i in range(2000)] + ["PART 17", "?", "n/a"]
    patterns = found(frame(spark, values))["v"]
    assert patterns[0] == ("^Part-[0-9]{4}$", 2000)
    assert accepted(patterns) == "^Part-[0-9]{4}$"


def test_lists_of_words_are_one_pattern(spark):
    rng = random.Random(1)
    values = [" ".join(rng.choice(["red", "green", "blue"]) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    patterns = found(frame(spark, values))["v"]
    assert patterns[0][1] == 3000 and patterns[0][0].count("(?:") == 1


def test_free_text_is_no_restriction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert accepted(found(docs, ["text"])["text"]) is None


def test_columns_together_are_as_each_alone(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    together = found(part)
    assert set(together) == {"p_name", "p_brand", "p_type"}
    assert found(part.repartition(7), ["p_name"]) == {"p_name": together["p_name"]}


def test_no_text_and_no_values(spark):
    assert found(spark.range(5)) == {}
    assert found(frame(spark, [None, None])) == {}
    assert found(frame(spark, [])) == {}
    with pytest.raises(ValueError, match="not text"):
        learned_patterns(spark.range(5), ["id"])


def test_suggested_pattern_counts_the_failing_rows(spark):
    source = frame(spark, [f"Item#{i:06d}" for i in range(300)])
    target = source.union(frame(spark, ["Item#12", "item#000001", None, "Item#000001\n"]))
    rows = suggest_checks("m", target, "t", learn_from=source, learn_patterns=True).collect()
    rule = next(r for r in rows if r.test_name == "v follows its pattern")
    assert rule.estimated_failures == 3
    target.createOrReplaceTempView("t")
    assert spark.sql(rule.sql_query).count() == 3
    assert "v follows its pattern" not in [
        r.test_name for r in suggest_checks("m", target, "t", learn_from=source).collect()
    ]


def test_values_are_read_on_all_levels_once_but_for_examples(spark, monkeypatch):
    read = []
    readings = patterns._readings
    monkeypatch.setattr(patterns, "_readings", lambda cells: (read.append(cells.count()), readings(cells))[1])
    assert found(frame(spark, [f"id-{k:04}" for k in range(500)]))["v"] == [("^id-[0-9]{4}$", 500)]
    assert read[0] == 500 and sum(read[1:]) <= 5
