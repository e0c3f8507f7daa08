import itertools
import random

import pytest

from tablecheck.operators import conformance as C
from tablecheck.operators.renames import assigned, column_signatures, renamed_columns
from tablecheck.plans.conformance import validate_schema
from tablecheck.sources.tables import from_frames


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_worth_most(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 5), rng.randint(1, 5)
    worth = [[rng.choice([0, 0, 0.5, 0.6, 0.9, 1]) for _ in range(m)] for _ in range(n)]
    got = assigned(worth)
    assert len({i for i, _ in got}) == len(got) == len({j for _, j in got})
    k = min(n, m)
    best = max(
        sum(worth[i][j] for i, j in zip(a, b)) for a in itertools.permutations(range(n), k)
        for b in itertools.combinations(range(m), k)
    )
    assert sum(worth[i][j] for i, j in got) == pytest.approx(best)


def test_similarity_follows_the_shared_values(spark):
    before = spark.range(1000).selectExpr("id AS a", "id + 400 AS b")
    after = spark.range(1000).selectExpr("CAST(id + 100 AS INT) AS x", "CAST(id + 300 AS DOUBLE) AS y")
    found = renamed_columns(column_signatures(before), column_signatures(after)).collect()
    assert {(r.old_name, r.new_name) for r in found} == {("a", "x"), ("b", "y")}
    assert all(abs(r.similarity - 900 / 1100) < 0.2 for r in found)


def test_nulls_nested_columns_and_empty_tables(spark):
    schema = "k int, gone string, v array<int>"
    df = spark.createDataFrame([(1, None, [1]), (2, None, None)], schema)
    assert rows(column_signatures(df).select("column_name", "rows", "filled")) == [("gone", 2, 0), ("k", 2, 2)]
    after = df.withColumnRenamed("gone", "new")
    assert renamed_columns(column_signatures(df), column_signatures(after)).collect() == []
    empty = spark.createDataFrame([], schema)
    assert renamed_columns(column_signatures(empty), column_signatures(df)).collect() == []
    assert column_signatures(df.select("v")).collect() == []


def test_signatures_of_parts_merge(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).selectExpr("id AS a", "CAST(id % 7 AS STRING) AS b")
    parts = column_signatures(df.where("id < 200")).union(column_signatures(df.where("id >= 200")))
    merged = parts.select("column_name", F.posexplode("signature")).groupBy("column_name", "pos").agg(F.min("col").alias("col"))
    whole = column_signatures(df).select("column_name", F.posexplode("signature"))
    assert rows(merged) == rows(whole)


def test_a_rename_is_one_finding(spark):
    model = spark.createDataFrame(
        [("t", "id", "INT64", False, None, None), ("t", "name", "STRING", True, None, None),
         ("t", "lost", "STRING", True, None, None)], C.MODEL_SCHEMA)
    earlier = spark.range(50).selectExpr("id", "concat('n', id) AS Name", "'x' AS lost")
    now = spark.range(50).selectExpr("id", "concat('n', id) AS title", "'y' AS extra")
    found = validate_schema(spark, model, from_frames({"t": now}), ["t"], earlier=from_frames({"t": earlier}))
    got = sorted((r.test_name, r.column_name) for r in found.collect())
    assert got == [("Missing column", "lost"), ("Renamed column", "title"), ("Undeclared column", "extra")]
    plain = validate_schema(spark, model, from_frames({"t": now}), ["t"])
    assert sorted(r.test_name for r in plain.collect()) == ["Missing column"] * 2 + ["Undeclared column"] * 2
