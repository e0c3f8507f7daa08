"""What must hold at scale, read off the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

from tablecheck.functions import predicates as P
from tablecheck.operators import duplicates, outliers, referential, rowchecks
from workload import checks, loads, records, suites  # noqa: F401  (registers the queries)
from workload.registered import QUERIES, load

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_row_checks_are_pushed_to_the_scan(spark):
    customer = load(spark, SF, "customer")
    text = plan(rowchecks.numeric_range(customer, {"c_acctbal": {"min": 0, "max": 9000}})
                .select("c_custkey"))
    assert "PushedFilters: [Or(LessThan(c_acctbal,0.0),And(GreaterThan(c_acctbal,9000.0)" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text
    orders = load(spark, SF, "orders")
    days = {"o_orderdate": {"min_date": "1996-01-01", "max_date": "2000-12-31"}}
    assert "Or(LessThan(o_orderdate,1996-01-01T00:00)" in plan(rowchecks.date_range(orders, days))
    assert "IsNull(o_orderkey)" in plan(rowchecks.no_nulls_required(orders, ["o_orderkey"]))


def test_fused_checks_scan_once_and_read_only_their_columns(spark):
    li = load(spark, SF, "lineitem")
    text = plan(rowchecks.fused_counts(li, {
        "a": P.null_predicate(li.schema, ["l_orderkey"]),
        "b": P.numeric_range_predicate(li.schema, {"l_quantity": {"min": 5, "max": 45}}),
    }))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_duplicate_keys_take_one_shuffle_after_a_partial_count(spark):
    text = plan(duplicates.no_duplicates_pk(load(spark, SF, "lineitem"), ["l_orderkey"]))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_count" in text
    assert "ReadSchema: struct<l_orderkey:bigint>" in text


def test_both_sides_of_the_anti_join_are_reduced_first(spark, no_broadcast):
    text = plan(referential.orphan_values(
        load(spark, SF, "lineitem"), "l_orderkey", load(spark, SF, "orders"), "o_orderkey"))
    assert "SortMergeJoin" in text and "LeftAnti" in text
    assert text.count("Exchange hashpartitioning") == 2
    for side in text.split("Exchange hashpartitioning")[1:]:
        assert side.lstrip().split("\n")[1].lstrip(" :+-").startswith("HashAggregate")


def test_outliers_need_no_join(spark):
    text = plan(outliers.outlier_detection(load(spark, SF, "events"), ["value"]))
    assert "Join" not in text and "Subquery" in text


def test_no_registered_query_has_a_cross_join(spark):
    eager = {"suite_results", "suite_mappings", "suite_summary", "mapping_counts",
             "custom_checks_run", "suggested_checks", "run_history_record",
             "single_file_comparison", "run_history_details", "config_isolation"}
    for name, query in QUERIES.items():
        if name in eager:
            continue
        text = plan(query(spark, SF))
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text), name
        assert "Python" not in text, name


def test_a_spread_hot_key_reaches_the_shuffle_as_few_rows(spark):
    df = spark.range(0, 300_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, F.lit(-7)).otherwise(F.col("id")).alias("k"))
    found = duplicates.no_duplicates_pk(df, ["k"])
    assert [tuple(r) for r in found.collect()] == [(-7, 100_000)]
