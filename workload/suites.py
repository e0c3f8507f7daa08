"""Whole suites: mappings run together, and the roll-ups of their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck import Mapping, mapping_metrics as runner_metrics, run_custom_checks, run_suite
from tablecheck.plans import rollups
from tablecheck.session import shared_dir
from tablecheck.sources import stores, tables as T

from .registered import load, query

REQUIRED = {"doc": ["doc_id", "quality", "toxic"], "event": ["event_id", "ts"]}


def loads_to_check(spark, sf_dir):
    """Four mappings and their tables; the last one names a table that does not exist."""
    documents = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    frames = {
        "doc": documents.join(labels, "doc_id", "left"),
        "event": load(spark, sf_dir, "events"),
        "shop.line": load(spark, sf_dir, "lineitem"),
        "label": labels,
        "building": load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"),
        "shop.recent": load(spark, sf_dir, "orders").where("o_orderdate >= '1996-01-01'"),
    }
    mappings = [
        Mapping(
            "documents_load",
            documents,
            "doc",
            auto_suggest=False,
            foreign_key_checks={"doc_id": {"table": "label", "column": "doc_id"}},
            pattern_checks={"source": "^[a-z]+$", "lang": "^(en|fr)$"},
            outlier_columns=("n_chars",),
            enabled_test_ids=(
                "row_count_match", "no_nulls_required", "no_duplicates_pk",
                "referential_integrity", "pattern_validation", "outlier_detection", "not_a_check",
            ),
        ),
        Mapping(
            "lineitem_load",
            load(spark, sf_dir, "orders"),
            "line",
            target_dataset="shop",
            auto_suggest=False,
            primary_key_columns=("l_orderkey", "l_linenumber"),
            required_columns=("l_orderkey", "l_shipdate"),
            numeric_range_checks={
                "l_quantity": {"min": 5, "max": 45}, "l_discount": {"min": 0, "max": 0.09},
            },
            date_range_checks={
                "l_shipdate": {"min_date": "1996-01-01", "max_date": "2000-12-31"},
            },
            foreign_key_checks={"l_orderkey": {"table": "shop.recent", "column": "o_orderkey"}},
            enabled_test_ids=(
                "no_nulls_required", "no_duplicates_pk", "referential_integrity",
                "numeric_range", "date_range",
            ),
        ),
        Mapping(
            "events_load",
            load(spark, sf_dir, "events"),
            "event",
            auto_suggest=False,
            numeric_range_checks={"event_type": {"min": 0, "max": 1}},
            date_range_checks={"ts": {"min_date": "2024-01-02", "max_date": "2024-01-29"}},
            foreign_key_checks={"user_id": {"table": "building", "column": "c_custkey"}},
            outlier_columns=("value",),
            enabled_test_ids=(
                "no_nulls_required", "numeric_range", "no_duplicates_pk", "date_range",
                "referential_integrity", "outlier_detection", "pattern_validation",
            ),
        ),
        Mapping("lost_load", documents, "no_such_table"),
    ]
    return mappings, T.from_frames(frames)


def suite(spark, sf_dir):
    return run_suite(spark, *loads_to_check(spark, sf_dir), REQUIRED)


# Violations of every check above, counted one by one.
_COUNTED = """
    counted(mapping_id, test_id, violating) AS (
        SELECT 'documents_load', 'row_count_match', abs((SELECT count(*) FROM documents)
            - (SELECT count(*) FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))
        UNION ALL SELECT 'documents_load', 'no_nulls_required', count(*)
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
            WHERE d.doc_id IS NULL OR quality IS NULL OR toxic IS NULL
        UNION ALL SELECT 'documents_load', 'no_duplicates_pk', count(*) FROM (
            SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
        UNION ALL SELECT 'documents_load', 'referential_integrity', count(DISTINCT doc_id)
            FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'documents_load', 'pattern_validation', count(*) FROM documents
            WHERE NOT regexp_matches(source, '^[a-z]+$') OR NOT regexp_matches(lang, '^(en|fr)$')
        UNION ALL SELECT 'documents_load', 'outlier_detection', count(*) FROM documents,
            (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS sd FROM documents)
            WHERE abs(n_chars - m) > 3 * sd
        UNION ALL SELECT 'lineitem_load', 'row_count_match',
            abs((SELECT count(*) FROM orders) - (SELECT count(*) FROM lineitem))
        UNION ALL SELECT 'lineitem_load', 'no_nulls_required', count(*) FROM lineitem
            WHERE l_orderkey IS NULL OR l_shipdate IS NULL
        UNION ALL SELECT 'lineitem_load', 'no_duplicates_pk', count(*) FROM (
            SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'lineitem_load', 'referential_integrity', count(DISTINCT l_orderkey)
            FROM lineitem WHERE l_orderkey NOT IN (
                SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
        UNION ALL SELECT 'lineitem_load', 'numeric_range', count(*) FROM lineitem
            WHERE l_quantity < 5 OR l_quantity > 45 OR l_discount < 0 OR l_discount > 0.09
        UNION ALL SELECT 'lineitem_load', 'date_range', count(*) FROM lineitem
            WHERE l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate > TIMESTAMP '2000-12-31'
        UNION ALL SELECT 'events_load', 'row_count_match', 0
        UNION ALL SELECT 'events_load', 'no_nulls_required', count(*) FROM events
            WHERE event_id IS NULL OR ts IS NULL
        UNION ALL SELECT 'events_load', 'numeric_range', NULL
        UNION ALL SELECT 'events_load', 'no_duplicates_pk', count(*) FROM (
            SELECT event_id FROM events GROUP BY event_id HAVING count(*) > 1)
        UNION ALL SELECT 'events_load', 'date_range', count(*) FROM events
            WHERE ts < TIMESTAMP '2024-01-02' OR ts > TIMESTAMP '2024-01-29'
        UNION ALL SELECT 'events_load', 'referential_integrity', count(DISTINCT user_id)
            FROM events WHERE user_id NOT IN (
                SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
        UNION ALL SELECT 'events_load', 'outlier_detection', count(*) FROM events,
            (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
            WHERE abs(value - m) > 3 * sd
    ),
    results AS (
        SELECT mapping_id, test_id,
               CASE WHEN violating IS NULL THEN 'ERROR' WHEN violating = 0 THEN 'PASS'
                    ELSE 'FAIL' END AS status,
               CAST(coalesce(violating, 0) AS BIGINT) AS rows_violating,
               CAST(coalesce(violating, 0) AS BIGINT) AS rows_affected
        FROM counted
    )"""


@query(f"WITH {_COUNTED} SELECT * FROM results")
def suite_results(spark, sf_dir):
    return suite(spark, sf_dir).results.select(
        "mapping_id", "test_id", "status", "rows_violating", "rows_affected"
    )


@query(f"""
    WITH {_COUNTED}
    SELECT test_id AS metric, rows_violating AS value FROM results
    WHERE mapping_id = 'lineitem_load' AND test_id <> 'row_count_match'
    UNION ALL SELECT 'source_rows', count(*) FROM orders
    UNION ALL SELECT 'target_rows', count(*) FROM lineitem
""")
def mapping_metrics(spark, sf_dir):
    """Everything one mapping counts, as the one lazy frame the runner executes."""
    mappings, tables = loads_to_check(spark, sf_dir)
    lineitem = next(m for m in mappings if m.mapping_id == "lineitem_load")
    found = runner_metrics(spark, lineitem, tables)
    return found.withColumn("metric", F.regexp_replace("metric", "^[0-9]+:", ""))


@query("""
    SELECT 'documents_load' AS mapping_id, 'doc' AS target,
           (SELECT count(*) FROM documents) AS file_row_count,
           (SELECT count(*) FROM documents) AS table_row_count, FALSE AS has_error
    UNION ALL SELECT 'lineitem_load', 'shop.line', (SELECT count(*) FROM orders),
           (SELECT count(*) FROM lineitem), FALSE
    UNION ALL SELECT 'events_load', 'event', (SELECT count(*) FROM events),
           (SELECT count(*) FROM events), FALSE
    UNION ALL SELECT 'lost_load', 'no_such_table', NULL, NULL, TRUE
""")
def suite_mappings(spark, sf_dir):
    return suite(spark, sf_dir).mappings.select(
        "mapping_id", "target", "file_row_count", "table_row_count",
        F.col("error").isNotNull().alias("has_error"),
    )


@query(f"""
    WITH {_COUNTED}
    SELECT CAST(4 AS BIGINT) AS total_mappings, count(*) AS total_tests,
           count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed,
           count(*) FILTER (status = 'ERROR') AS errors, CAST(0 AS BIGINT) AS total_suggestions,
           'ERROR' AS run_status
    FROM results
""")
def suite_summary(spark, sf_dir):
    run = suite(spark, sf_dir)
    errors = run.mappings.agg(F.count("error").alias("mapping_errors"))
    summary = rollups.suite_summary(run.results, run.mappings)
    both = summary.withColumn("mapping_errors", errors.scalar())
    return rollups.run_status(both, "config").drop("mapping_errors")


@query(f"""
    WITH {_COUNTED}
    SELECT mapping_id, count(*) FILTER (status = 'PASS') AS "PASS",
           count(*) FILTER (status = 'FAIL') AS "FAIL", count(*) FILTER (status = 'ERROR') AS "ERROR"
    FROM results GROUP BY mapping_id
""")
def mapping_counts(spark, sf_dir):
    return rollups.mapping_counts(suite(spark, sf_dir).results)


@query(f"""
    WITH {_COUNTED}
    SELECT 'gcs_config_table' AS comparison_mode, 'AT_RISK' AS status, count(*) AS total_tests,
           count(*) FILTER (status = 'PASS') AS passed_tests,
           count(*) FILTER (status = 'FAIL') AS failed_tests,
           count(*) FILTER (status = 'ERROR') AS other
    FROM results
""")
def run_history_record(spark, sf_dir):
    """A suite logged in the run history and read back; its counts come from its details."""
    run = suite(spark, sf_dir)
    store = stores.run_history_store(spark, shared_dir(spark, "runs"))
    stores.log_runs(
        store,
        rollups.run_record(
            run.results, run.mappings, "config", "config.loads", "several", legacy_rules=True
        ),
    )
    saved = store.read()
    counted = rollups.summary_from_details(saved).drop("total_tests", "errors")
    return (
        rollups.with_other(stores.recent_runs(saved))
        .drop("passed_tests", "failed_tests")
        .join(counted, "execution_id")
        .select(
            "comparison_mode", "status", "total_tests", F.col("passed").alias("passed_tests"),
            F.col("failed").alias("failed_tests"), "other",
        )
    )


# Stored results at scale: each event stands for one check result of the mapping user_id.
_EVENT_STATUS = """
    CASE WHEN value > 100 THEN 'ERROR' WHEN event_type IN ('click', 'view') THEN 'PASS'
         ELSE 'FAIL' END"""


def _event_results(spark, sf_dir):
    status = F.when(F.col("value") > 100, "ERROR").otherwise(
        F.when(F.col("event_type").isin("click", "view"), "PASS").otherwise("FAIL")
    )
    return load(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("execution_id"),
        F.col("user_id").cast("string").alias("mapping_id"),
        F.col("event_type").alias("test_id"),
        F.col("event_type").alias("test_name"),
        status.alias("status"),
        F.get_json_object("props", "$.k").cast("long").alias("rows_affected"),
        F.col("ts").alias("executed_at"),
    )


@query(f"""
    SELECT user_id AS mapping_id, count(*) FILTER (s = 'PASS') AS "PASS",
           count(*) FILTER (s = 'FAIL') AS "FAIL", count(*) FILTER (s = 'ERROR') AS "ERROR"
    FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, {_EVENT_STATUS} AS s FROM events)
    GROUP BY user_id
""")
def mapping_counts_stored(spark, sf_dir):
    return rollups.mapping_counts(_event_results(spark, sf_dir))


@query(f"SELECT {_EVENT_STATUS} AS status, count(*) AS n FROM events GROUP BY 1")
def status_distribution(spark, sf_dir):
    return rollups.status_distribution(_event_results(spark, sf_dir))


@query(f"""
    SELECT count(*) AS total_tests, count(*) FILTER (s = 'PASS') AS passed,
           count(*) FILTER (s = 'FAIL') AS failed, count(*) FILTER (s = 'ERROR') AS errors
    FROM (SELECT {_EVENT_STATUS} AS s FROM events)
""")
def check_summary(spark, sf_dir):
    return rollups.check_summary(_event_results(spark, sf_dir))


@query(f"""
    WITH r AS (SELECT CAST(user_id AS VARCHAR) AS mapping_id, {_EVENT_STATUS} AS s FROM events),
    c AS (SELECT mapping_id, count(*) FILTER (s = 'FAIL') AS failed,
                 count(*) FILTER (s = 'ERROR') AS errors FROM r GROUP BY mapping_id)
    SELECT mapping_id, failed, errors,
           CASE WHEN failed > 0 THEN 'AT_RISK' ELSE 'PASS' END AS config_status,
           CASE WHEN failed > 0 OR errors > 0 THEN 'FAIL' ELSE 'PASS' END AS single_status,
           CASE WHEN failed + errors > 0 THEN 'AT_RISK' ELSE 'PASS' END AS schema_status,
           CASE WHEN errors > 0 THEN 'ERROR' WHEN failed > 0 THEN 'AT_RISK' ELSE 'PASS' END
               AS strict_status
    FROM c
""")
def run_status(spark, sf_dir):
    counts = rollups.mapping_counts(_event_results(spark, sf_dir)).select(
        "mapping_id", F.col("FAIL").alias("failed"), F.col("ERROR").alias("errors"),
        (F.col("FAIL") + F.col("ERROR")).alias("total_issues"),
        F.col("ERROR").alias("mapping_errors"),
    )
    for name, mode, legacy in (
        ("config_status", "config", True), ("single_status", "single", True),
        ("schema_status", "schema", True), ("strict_status", "config", False),
    ):
        counts = rollups.run_status(counts, mode, legacy).withColumnRenamed("run_status", name)
    return counts.drop("total_issues", "mapping_errors")


@query("""
    SELECT CAST(event_id AS VARCHAR) AS execution_id, ts AS run_at, event_type AS status
    FROM events ORDER BY ts DESC LIMIT 50
""")
def history_top_n(spark, sf_dir):
    runs = load(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("execution_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("status"),
    )
    return stores.recent_runs(runs, 50).withColumnRenamed("timestamp", "run_at")


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS execution_id, o_orderdate AS run_at,
           CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'P' THEN 'UNKNOWN' ELSE 'PASS' END
               AS status,
           l.total AS total_tests, l.passed AS passed_tests, l.failed AS failed_tests,
           l.total - l.passed - l.failed AS other
    FROM orders JOIN (
        SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS passed,
               count(*) FILTER (l_returnflag = 'R') AS failed
        FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
""")
def history_append_read(spark, sf_dir):
    """Runs appended in two batches under their own times and read back, `other` added."""
    counts = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(F.col("l_returnflag") == "A").alias("passed_tests"),
        F.count_if(F.col("l_returnflag") == "R").alias("failed_tests"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS")
    runs = load(spark, sf_dir, "orders").join(
        counts, F.col("o_orderkey") == F.col("l_orderkey")
    ).select(
        F.col("o_orderkey").cast("string").alias("execution_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        status.alias("status"),
        "total_tests", "passed_tests", "failed_tests",
    )
    store = stores.run_history_store(spark, shared_dir(spark, "runs"))
    for part in ("status IS NULL", "status IS NOT NULL"):
        stores.log_runs(store, runs.where(part))
    return rollups.with_other(store.read()).select(
        "execution_id", F.col("timestamp").cast("timestamp_ntz").alias("run_at"), "status",
        "total_tests", "passed_tests", "failed_tests", "other",
    )


@query(f"""
    SELECT CAST(event_id AS VARCHAR) AS execution_id, {_EVENT_STATUS} AS status,
           CAST(json_extract(props, '$.k') AS BIGINT) AS rows_affected
    FROM events WHERE user_id = 8 ORDER BY ts DESC LIMIT 100
""")
def mapping_check_history(spark, sf_dir):
    return stores.mapping_history(_event_results(spark, sf_dir), "8").select(
        "execution_id", "status", "rows_affected"
    )


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS execution_id, CAST(3 AS BIGINT) AS total_tests,
           CAST((o_orderstatus = 'F')::INT + (o_totalprice > 100000)::INT
                + (o_custkey > 700)::INT AS BIGINT) AS passed,
           CAST((o_orderstatus <> 'F')::INT + (o_totalprice <= 100000)::INT AS BIGINT) AS failed,
           CAST((o_custkey <= 700)::INT AS BIGINT) AS errors
    FROM orders
""")
def summary_from_details(spark, sf_dir):
    def result(test, otherwise: str):
        return F.struct(F.when(test, "PASS").otherwise(otherwise).alias("status"))

    results = F.array(
        result(F.col("o_orderstatus") == "F", "FAIL"),
        result(F.col("o_totalprice") > 100000, "FAIL"),
        result(F.col("o_custkey") > 700, "ERROR"),
    )
    runs = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("execution_id"),
        F.to_json(F.struct(results.alias("results"))).alias("details"),
    )
    return rollups.summary_from_details(runs)


@query("""
    SELECT 'orders without lines' AS test_name, 'FAIL' AS status, count(*) AS rows_affected
    FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL
    SELECT 'price per line is positive', 'PASS', 0
    UNION ALL SELECT 'no such column', 'ERROR', 0
    UNION ALL SELECT 'changes nothing', 'ERROR', 0
""")
def custom_checks_run(spark, sf_dir):
    """Saved check queries, read back and run over whole tables."""
    for name in ("orders", "lineitem"):
        load(spark, sf_dir, name).createOrReplaceTempView(f"tc_{name}")
    rows = spark.createDataFrame(
        [
            ("orders without lines", "SELECT o.* FROM tc_orders o LEFT ANTI JOIN tc_lineitem"
             " ON l_orderkey = o_orderkey -- whole orders", None),
            ("price per line is positive", "SELECT * FROM tc_lineitem"
             " WHERE l_extendedprice <= 0;", None),
            ("no such column", "SELECT * FROM tc_orders WHERE o_colour = 'red'", None),
            ("changes nothing", "CREATE TABLE tc_made AS SELECT 1 AS x", None),
            ("blank", " ; ", None),
            ("switched off", "SELECT * FROM tc_orders", False),
        ],
        "test_name string, sql_query string, is_active boolean",
    ).withColumns(
        {"test_category": F.lit("business"), "severity": F.lit("LOW"),
         "target_table": F.lit("orders")}
    )
    store = stores.custom_check_store(spark, shared_dir(spark, "custom-checks"))
    stores.add_custom_checks(store, rows)
    active = stores.active_custom_checks(store.read(), "orders")
    return run_custom_checks(spark, active).select("test_name", "status", "rows_affected")
