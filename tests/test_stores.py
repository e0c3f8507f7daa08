import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablecheck.plans import registry
from tablecheck.sources import stores


def test_reading_before_the_first_append(spark, tmp_path):
    store = stores.run_history_store(spark, str(tmp_path / "runs"))
    assert store.read().count() == 0
    assert [f.name for f in store.read().schema] == [f.name for f in stores.RUN_HISTORY]


def test_mappings_are_switched_off_without_rewriting(spark, tmp_path):
    store = stores.config_store(spark, str(tmp_path / "config"))
    stores.add_mappings(store, spark.createDataFrame(
        [("m1", "t1"), ("m2", "t2")], "mapping_id string, target_table string"))
    before = {r.mapping_id: r for r in store.read().collect()}
    assert before["m1"].is_active and before["m1"].auto_suggest
    stores.set_mapping_active(store, "m1", False)
    after = {r.mapping_id: r for r in store.read().collect()}
    assert len(after) == 2 and not after["m1"].is_active and after["m2"].is_active
    assert after["m1"].updated_at > before["m1"].updated_at
    assert after["m1"].target_table == "t1"
    assert [r.mapping_id for r in stores.active_mappings(store.read()).collect()] == ["m2"]
    stores.set_mapping_active(store, "m1", True)
    assert stores.active_mappings(store.read()).count() == 2
    assert store.versions().count() == 4


def test_null_flag_is_not_active(spark):
    config = spark.createDataFrame([("a", True), ("b", None), ("c", False)],
                                   "mapping_id string, is_active boolean")
    assert [r.mapping_id for r in stores.active_mappings(config).collect()] == ["a"]


def test_custom_checks_get_id_time_and_flag(spark, tmp_path):
    store = stores.custom_check_store(spark, str(tmp_path / "custom"))
    for name, table in (("one", "t"), ("two", "u")):
        stores.add_custom_checks(store, spark.createDataFrame(
            [(name, table, "SELECT 1")], "test_name string, target_table string, sql_query string"))
    saved = store.read().collect()
    assert len({r.test_id for r in saved}) == 2 and all(r.created_at for r in saved)
    found = stores.active_custom_checks(store.read(), "u").collect()
    assert [r.test_name for r in found] == ["two"]


def test_suggestions_are_reviewed_once_each(spark, tmp_path):
    store = stores.suggestion_store(spark, str(tmp_path / "s"))
    stores.add_suggestions(store, spark.createDataFrame(
        [("m", n, "quality", "LOW", "SELECT 1") for n in "abc"],
        "mapping_id string, test_name string, test_category string, severity string,"
        " sql_query string"))
    assert stores.pending_suggestions(store.read()).count() == 3
    stores.review_suggestions(store, F.col("test_name") == "a", "approved", "me", "good")
    stores.review_suggestions(store, F.col("test_name") == "b", "rejected", "me")
    state = {r.test_name: (r.status, r.reviewed_by) for r in store.read().collect()}
    assert state == {"a": ("approved", "me"), "b": ("rejected", "me"), "c": ("pending", None)}
    with pytest.raises(ValueError):
        stores.review_suggestions(store, "true", "maybe")


def test_runs_newest_first_with_defaults(spark, tmp_path):
    store = stores.run_history_store(spark, str(tmp_path / "runs"))
    for day in range(1, 6):
        stores.log_runs(store, spark.createDataFrame(
            [(f"r{day}", dt.datetime(2024, 1, day), 3)],
            "execution_id string, timestamp timestamp, total_tests int"))
    stores.log_runs(store, spark.createDataFrame([("p",)], "project_id string"))
    newest = stores.recent_runs(store.read(), 3).collect()
    assert newest[0].status == "UNKNOWN" and newest[0].comparison_mode == "unknown"
    assert newest[0].source == "" and newest[0].total_tests == 0
    assert [r.execution_id for r in newest[1:]] == ["r5", "r4"]


def test_history_of_one_mapping(spark, tmp_path):
    store = stores.check_history_store(spark, str(tmp_path / "checks"))
    rows = [(f"e{i}", "m" if i % 2 else "n", "t", "T", "PASS", dt.datetime(2024, 1, 1 + i))
            for i in range(6)]
    stores.log_checks(store, spark.createDataFrame(
        rows, "execution_id string, mapping_id string, test_id string, test_name string,"
        " status string, executed_at timestamp"))
    found = stores.mapping_history(store.read(), "m", 2).collect()
    assert [r.execution_id for r in found] == ["e5", "e3"]


def test_check_definitions_are_seeded_once(spark, tmp_path):
    store = stores.check_definition_store(spark, str(tmp_path / "definitions"))
    for _ in range(2):
        stores.seed_check_definitions(store, registry.frame(spark))
    rows = {r.test_id: r for r in store.read().collect()}
    assert len(rows) == store.versions().count() == 8
    assert rows["numeric_range"].is_system and not rows["numeric_range"].is_global
    assert rows["numeric_range"].created_by == "system" and rows["numeric_range"].created_at


def test_a_mapping_added_again_replaces_the_one_switched_off(spark, tmp_path):
    store = stores.config_store(spark, str(tmp_path / "config"))
    schema = "mapping_id string, target_table string"
    stores.add_mappings(store, spark.createDataFrame([("m", "old"), ("n", "t")], schema))
    stores.set_mapping_active(store, "m", False)
    stores.add_mappings(store, spark.createDataFrame([("m", "new")], schema))
    active = {r.mapping_id: r.target_table for r in stores.active_mappings(store.read()).collect()}
    assert active == {"m": "new", "n": "t"}
    with pytest.raises(ValueError, match="more than once"):
        stores.add_mappings(store, spark.createDataFrame([("x", "a"), ("x", "b")], schema))


def test_rows_of_one_version_are_ordered_for_every_reader(spark, tmp_path):
    store = stores.config_store(spark, str(tmp_path / "config"))
    for table in "abc":  # as concurrent writers would
        store.append(spark.createDataFrame([("m", table)], "mapping_id string, target_table string"))
    assert {store.read().first().target_table for _ in range(3)} == {"c"}


def test_a_month_is_one_file_and_newest_reads_few_months(spark, tmp_path):
    store = stores.run_history_store(spark, str(tmp_path / "runs"))
    runs = spark.range(0, 4000, 1, 8).select(
        F.col("id").cast("string").alias("execution_id"),
        F.expr("timestamp'2024-01-01' + make_interval(0, cast(id % 20 AS int), 0, cast(id % 7 AS int))").alias("timestamp"))
    stores.log_runs(store, runs)
    assert len(list((tmp_path / "runs").glob("run_month=*/*.parquet"))) == 20
    newest = stores.newest_runs(store, 50)
    assert newest.collect() == stores.recent_runs(store.read(), 50).collect()
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_month" in plan
    assert store.newest(10_000).count() == 4000 and store.newest(5, "status = 'no'").count() == 0
