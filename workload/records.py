"""Stored records: histories by month, runs with their details, mappings added again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck import run_config
from tablecheck.plans import rollups
from tablecheck.plans.conformance import schema_summary, validate_schema
from tablecheck.session import shared_dir
from tablecheck.sources import stores, tables as T

from . import loads, suites
from .registered import ORACLE, load, query


@query(ORACLE["history_top_n"])
def history_newest_stored(spark, sf_dir):
    """Runs stored by month; only the months of the newest are read."""
    store = stores.run_history_store(spark, shared_dir(spark, "runs"))
    stores.log_runs(store, load(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("execution_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("status"),
    ))
    return stores.newest_runs(store, 50).select(
        "execution_id", F.col("timestamp").cast("timestamp_ntz").alias("run_at"), "status"
    )


@query(ORACLE["mapping_check_history"])
def mapping_history_stored(spark, sf_dir):
    """Check results stored by month; only months with results of the mapping are read."""
    store = stores.check_history_store(spark, shared_dir(spark, "checks"))
    results = suites._event_results(spark, sf_dir)
    stores.log_checks(store, results.withColumn("executed_at", F.col("executed_at").cast("timestamp")))
    return stores.newest_of_mapping(store, "8").select("execution_id", "status", "rows_affected")


@query("""
    SELECT c_name AS mapping_id, c_mktsegment AS description FROM customer
    WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT c_name, 'again' FROM customer
    WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10
""")
def mapping_added_again(spark, sf_dir):
    """Mappings stored, those of one segment switched off, some of them added again."""
    store = stores.config_store(spark, shared_dir(spark, "config"))
    config = loads._config(spark, sf_dir).drop("is_active")
    stores.add_mappings(store, config)
    store.change("description = 'BUILDING'", is_active=F.lit(False))
    back = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey < 10")
    stores.add_mappings(store, back.select(
        F.col("c_name").alias("mapping_id"), F.lit("again").alias("description")
    ))
    return stores.active_mappings(store.read()).select("mapping_id", "description")


@query(f"""
    WITH findings AS ({ORACLE["schema_findings"]}), n AS (SELECT count(*) AS issues FROM findings)
    SELECT 'schema_validation' AS comparison_mode,
           CASE WHEN issues > 0 THEN 'AT_RISK' ELSE 'PASS' END AS status,
           CAST(4 AS BIGINT) AS total_tests, greatest(4 - issues, 0) AS passed_tests,
           issues AS failed_tests
    FROM n
""")
def run_history_schema(spark, sf_dir):
    """A run over schemas, recorded and read back."""
    names = ("customer", "part", "nation", "region")
    findings = validate_schema(
        spark, spark.createDataFrame(loads._MODEL, loads.conformance.MODEL_SCHEMA),
        T.from_directory(spark, sf_dir), names, key_candidates=loads.KEY_CANDIDATES,
    )
    store = stores.run_history_store(spark, shared_dir(spark, "runs"))
    record = rollups.schema_record(schema_summary(findings, len(names)), "model", "tables")
    stores.log_runs(store, record)
    return stores.newest_runs(store).select(
        "comparison_mode", "status", "total_tests", "passed_tests", "failed_tests"
    )


@query(f"""
    WITH {suites._COUNTED}, of_mapping AS (
        SELECT mapping_id, count(*) AS n_results, count(*) FILTER (status = 'FAIL') AS n_failed
        FROM results GROUP BY mapping_id
    )
    SELECT m.*, coalesce(n_results, 0) AS n_results, coalesce(n_failed, 0) AS n_failed
    FROM ({ORACLE["suite_mappings"]}) m LEFT JOIN of_mapping USING (mapping_id)
""")
def run_history_details(spark, sf_dir):
    """What each mapping of a suite found, stored a row for each and read back."""
    run = suites.suite(spark, sf_dir)
    store = stores.run_details_store(spark, shared_dir(spark, "details"))
    stores.log_run_details(store, rollups.run_details(run.results, run.mappings, "run-1", run.suggestions))
    found = F.from_json("predefined_results", "array<struct<status:string>>")
    failed = F.filter(found, lambda r: r["status"] == "FAIL")
    return store.read().select(
        "mapping_id", "target",
        F.col("source_row_count").alias("file_row_count"),
        F.col("target_row_count").alias("table_row_count"),
        F.col("error").isNotNull().alias("has_error"),
        F.size(found).cast("long").alias("n_results"),
        F.size(failed).cast("long").alias("n_failed"),
    )


@query("""
    SELECT o_orderstatus AS mapping_id, FALSE AS has_error, count(*) AS file_row_count,
           (SELECT count(*) FROM orders) AS table_row_count
    FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'no bucket', TRUE, NULL, NULL
    UNION ALL SELECT 'no such file', TRUE, NULL, NULL
    UNION ALL SELECT 'broken settings', TRUE, NULL, NULL
""")
def config_isolation(spark, sf_dir):
    """A configuration table with good rows and bad ones; the bad ones end nothing."""
    root = shared_dir(spark, "source-orders")
    orders = load(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus"))
    orders.write.option("header", "true").partitionBy("status").csv(root)
    good = orders.select("status").distinct().select(
        F.col("status").alias("mapping_id"), F.lit(root).alias("source_bucket"),
        F.concat(F.lit("status="), "status", F.lit("/*.csv")).alias("source_file_path"),
        F.lit(None).cast("string").alias("pattern_checks"),
    )
    bad = spark.createDataFrame(
        [("no bucket", None, "x.csv", None), ("no such file", root, "gone/*.csv", None),
         ("broken settings", root, "status=F/*.csv", "{not json")],
        "mapping_id string, source_bucket string, source_file_path string, pattern_checks string",
    )
    config = good.union(bad).withColumns({
        "source_file_format": F.lit("csv"), "target_table": F.lit("orders"),
        "target_dataset": F.lit(None).cast("string"), "is_active": F.lit(True),
        "auto_suggest": F.lit(False), "enabled_test_ids": F.array(F.lit("row_count_match")),
    })
    run = run_config(spark, config, T.from_directory(spark, sf_dir))
    return run.mappings.select(
        "mapping_id", F.col("error").isNotNull().alias("has_error"),
        "file_row_count", "table_row_count",
    )
