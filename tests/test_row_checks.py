import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablecheck.functions import predicates as P
from tablecheck.functions.regex import to_java
from tablecheck.operators import rowchecks
from tablecheck.operators.outliers import outlier_detection


def ids(df):
    return sorted(r.id for r in df.collect())


def test_nulls_in_any_required_column(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, None, 1.0), (3, "c", None), (4, None, None)],
        "id int, name string, v double",
    )
    assert ids(rowchecks.no_nulls_required(df, ["name"])) == [2, 4]
    assert ids(rowchecks.no_nulls_required(df, ["name", "v"])) == [2, 3, 4]


def test_nested_and_dotted_column_names(spark):
    df = spark.createDataFrame([(1, ("x",)), (2, (None,))], "id int, a struct<b:string>")
    assert ids(rowchecks.no_nulls_required(df, ["a.b"])) == [2]
    flat = df.select("id", F.lit(None).cast("int").alias("a.b"))
    assert ids(rowchecks.no_nulls_required(flat, ["a.b"])) == [1, 2]


def test_range_bounds_are_inclusive_and_null_or_nan_never_violate(spark):
    rows = [(1, 0.0), (2, 100.0), (3, -0.1), (4, 100.1), (5, None), (6, float("nan")),
            (7, float("inf")), (8, float("-inf"))]
    df = spark.createDataFrame(rows, "id int, v double")
    assert ids(rowchecks.numeric_range(df, {"v": {"min": 0, "max": 100}})) == [3, 4, 7, 8]
    single = df.select("id", F.col("v").cast("float").alias("v"))
    assert ids(rowchecks.numeric_range(single, {"v": {"min": 0, "max": 100}})) == [3, 4, 7, 8]


def test_null_in_one_column_does_not_hide_another(spark):
    df = spark.createDataFrame([(1, None, 500), (2, None, 5)], "id int, a int, b int")
    checks = {"a": {"min": 0, "max": 9}, "b": {"min": 0, "max": 9}}
    assert ids(rowchecks.numeric_range(df, checks)) == [1]


def test_integer_and_decimal_bounds_compare_exactly(spark):
    big = 2**53
    df = spark.createDataFrame([(1, big), (2, big + 1)], "id int, v bigint")
    assert ids(rowchecks.numeric_range(df, {"v": {"min": 0, "max": big}})) == [2]
    assert ids(rowchecks.numeric_range(df, {"v": {"min": 0, "max": big + 0.0}})) == [2]
    money = spark.createDataFrame([(1, Decimal("0.30")), (2, Decimal("0.31"))],
                                  "id int, v decimal(10,2)")
    assert ids(rowchecks.numeric_range(money, {"v": {"min": 0, "max": 0.3}})) == [2]


@pytest.mark.parametrize(
    "bounds", [{"min": 1}, {"max": 1}, {"min": "x", "max": 2}, {"min": 0, "max": float("nan")}]
)
def test_range_without_two_finite_numbers_is_refused(spark, bounds):
    df = spark.createDataFrame([(1, 1)], "id int, v int")
    with pytest.raises(Exception):
        P.numeric_range_predicate(df.schema, {"v": bounds})


def test_range_on_text_is_refused(spark):
    df = spark.createDataFrame([(1, "1")], "id int, v string")
    with pytest.raises(ValueError, match="numeric range"):
        P.numeric_range_predicate(df.schema, {"v": {"min": 0, "max": 1}})


def test_day_bound_of_a_timestamp_is_midnight(spark):
    rows = [(1, dt.datetime(2024, 12, 31)), (2, dt.datetime(2024, 12, 31, 0, 0, 1)),
            (3, dt.datetime(2023, 12, 31, 23, 59)), (4, None)]
    df = spark.createDataFrame(rows, "id int, at timestamp_ntz")
    check = {"min_date": "2024-01-01", "max_date": "2024-12-31"}
    assert ids(rowchecks.date_range(df, {"at": check})) == [2, 3]
    days = df.select("id", F.to_date("at").alias("at"))
    assert ids(rowchecks.date_range(days, {"at": check})) == [3]
    text = df.select("id", F.col("at").cast("string").alias("at"))
    assert ids(rowchecks.date_range(text, {"at": check})) == [1, 2, 3]


@pytest.mark.parametrize("bad", ["2024-13-45", "soon", "2024-01-01 10:00:00"])
def test_malformed_date_bound_is_refused(spark, bad):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "id int, d date")
    with pytest.raises(ValueError):
        rowchecks.date_range(df, {"d": {"min_date": bad, "max_date": "2024-12-31"}})


def test_pattern_is_searched_and_null_passes(spark):
    rows = [(1, "a@b.c"), (2, "nobody"), (3, None), (4, "a@b.c\n"), (5, "")]
    df = spark.createDataFrame(rows, "id int, mail string")
    assert ids(rowchecks.pattern_validation(df, {"mail": r"^[^@]+@[^@]+\.[^@\n]+$"})) == [2, 4, 5]
    assert ids(rowchecks.pattern_validation(df, {"mail": "@"})) == [2, 5]


def test_pattern_with_quotes_and_on_numbers(spark):
    df = spark.createDataFrame([(1, "it's", 12), (2, "its", 123)], "id int, t string, n int")
    assert ids(rowchecks.pattern_validation(df, {"t": "t's"})) == [2]
    assert ids(rowchecks.pattern_validation(df, {"n": r"^\d{2}$"})) == [2]
    nested = df.select("id", F.array("t").alias("t"))
    with pytest.raises(ValueError, match="pattern on"):
        rowchecks.pattern_validation(nested, {"t": "x"})


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"a++", r"(?>a)", "a(", "[a"])
def test_patterns_re2_refuses(spark, pattern):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    with pytest.raises(Exception):
        rowchecks.pattern_validation(df, {"t": pattern})


@pytest.mark.parametrize(
    "pattern, text, found",
    [
        ("a$", "a\n", False),
        ("(?m)a$", "a\nb", True),
        ("a.b", "a\rb", True),
        ("a.b", "a\nb", False),
        ("[[:alpha:]]+$", "12ab", True),
        ("[[:alpha:]]", "12:", False),
        ("^[[]$", "[", True),
        ("^[a&&b]+$", "a&b", True),
        (r"^\$5$", "$5", True),
        (r"^\Qa$\E$", "a$", True),
        ("(?P<x>a)b", "ab", True),
        ("(?i)É", "é", True),
        ("^[]a]+$", "]a", True),
    ],
)
def test_java_pattern_finds_what_re2_finds(spark, pattern, text, found):
    got = spark.createDataFrame([(text,)], "t string").where(F.col("t").rlike(to_java(pattern)))
    assert (got.count() == 1) is found


def test_fused_counts_equal_separate_counts(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"), (F.col("id") % 10).alias("d")
    )
    predicates = {
        "nulls": P.null_predicate(df.schema, ["v"]),
        "range": P.numeric_range_predicate(df.schema, {"v": {"min": 10, "max": 900},
                                                       "d": {"min": 1, "max": 9}}),
    }
    fused = {r.metric: r.value for r in rowchecks.fused_counts(df, predicates).collect()}
    assert fused == {
        "rows": 1000, **{k: df.where(p).count() for k, p in predicates.items()}
    }


def test_outliers_need_more_than_three_deviations(spark):
    rows = [(i, 0.0) for i in range(20)] + [(99, 1000.0), (100, None)]
    df = spark.createDataFrame(rows, "id int, v double")
    assert ids(outlier_detection(df, ["v"])) == [99]


def test_no_outliers_in_constant_single_or_nan_columns(spark):
    constant = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, v double")
    assert ids(outlier_detection(constant, ["v"])) == []
    assert ids(outlier_detection(constant.limit(1), ["v"])) == []
    nan = spark.createDataFrame([(i, 0.0) for i in range(20)] + [(99, float("nan"))],
                                "id int, v double")
    assert ids(outlier_detection(nan, ["v"])) == []


def test_outliers_of_first_or_all_columns(spark):
    rows = [(i, 0.0, Decimal("1")) for i in range(20)]
    rows += [(98, 0.0, Decimal("500")), (99, 1000.0, Decimal("1"))]
    df = spark.createDataFrame(rows, "id int, v double, w decimal(9,2)")
    assert ids(outlier_detection(df, ["v", "w"])) == [99]
    assert ids(outlier_detection(df, ["v", "w"], which="all")) == [98, 99]
    with pytest.raises(ValueError):
        outlier_detection(df.withColumn("t", F.lit("x")), ["t"])
