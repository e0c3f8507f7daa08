"""Summaries of check results and of stored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATUSES = ("PASS", "FAIL", "ERROR")

# How the kinds of run are named in the history.
MODES = {
    "config": "gcs_config_table",
    "single": "gcs_single_file",
    "schema": "schema_validation",
}


def _status_counts() -> list[Column]:
    return [
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
    ]


def check_summary(results: DataFrame) -> DataFrame:
    """One row: total_tests, passed, failed, errors."""
    return results.agg(F.count(F.lit(1)).alias("total_tests"), *_status_counts())


def suite_summary(
    results: DataFrame, mappings: DataFrame, suggestions: DataFrame | None = None
) -> DataFrame:
    """One row: total_mappings, total_tests, passed, failed, errors, total_suggestions.

    Mappings that ended in an error count as mappings although they have no results.
    """
    parts = results.select("status", F.lit("test").alias("part")).unionByName(
        mappings.select(F.lit(None).cast("string").alias("status"), F.lit("mapping").alias("part"))
    )
    if suggestions is not None:
        parts = parts.unionByName(
            suggestions.select(
                F.lit(None).cast("string").alias("status"), F.lit("suggestion").alias("part")
            )
        )
    return parts.agg(
        F.count_if(F.col("part") == "mapping").alias("total_mappings"),
        F.count_if(F.col("part") == "test").alias("total_tests"),
        *_status_counts(),
        F.count_if(F.col("part") == "suggestion").alias("total_suggestions"),
    )


def mapping_counts(results: DataFrame) -> DataFrame:
    """mapping_id and the number of its PASS, FAIL and ERROR results."""
    return results.groupBy("mapping_id").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES)
    )


def status_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def with_other(runs: DataFrame) -> DataFrame:
    """Adds `other`: tests of a run that neither passed nor failed."""
    count = {c: F.coalesce(F.col(c), F.lit(0)) for c in
             ("total_tests", "passed_tests", "failed_tests")}
    return runs.withColumn(
        "other", count["total_tests"] - count["passed_tests"] - count["failed_tests"]
    )


def run_status(summary: DataFrame, mode: str, legacy_rules: bool = False) -> DataFrame:
    """Adds run_status to rows of counts.

    mode "config": AT_RISK if a check failed; "single": FAIL if one failed or errored;
    "schema": AT_RISK if there are issues. Unless legacy_rules, a run in which a
    mapping errored (mapping_errors > 0) is an ERROR, whatever its other checks say.
    """
    if mode == "config":
        status = F.when(F.col("failed") > 0, "AT_RISK").otherwise("PASS")
    elif mode == "single":
        status = F.when((F.col("failed") > 0) | (F.col("errors") > 0), "FAIL").otherwise("PASS")
    elif mode == "schema":
        status = F.when(F.col("total_issues") > 0, "AT_RISK").otherwise("PASS")
    else:
        raise ValueError(f"mode must be config, single or schema, not {mode!r}")
    if not legacy_rules and "mapping_errors" in summary.columns:
        status = F.when(F.col("mapping_errors") > 0, "ERROR").otherwise(status)
    return summary.withColumn("run_status", status)


def summary_from_details(runs: DataFrame) -> DataFrame:
    """execution_id and the counts of a stored run's results, from its details JSON.

    A details object without its own summary is counted from the results it lists; one
    with neither has NULL counts. The counting is done inside the row, so no results are
    exploded or shuffled, and the JSON is parsed once.
    """
    result = "array<struct<status:string>>"
    counts = "struct<total_tests:bigint,passed:bigint,failed:bigint,errors:bigint>"
    parsed = F.from_json(
        "details", f"struct<summary:{counts},predefined_results:{result},results:{result}>"
    )

    def listed(details: Column) -> Column:
        return F.coalesce(details["predefined_results"], details["results"])

    def having(status: str) -> Column:
        found = F.filter(listed(F.col("parsed")), lambda r: r["status"] == status)
        return F.when(found.isNotNull(), F.size(found).cast("long"))

    def total() -> Column:
        found = listed(F.col("parsed"))
        return F.when(found.isNotNull(), F.size(found).cast("long"))

    rows = runs.select("execution_id", parsed.alias("parsed"))
    stored = F.col("parsed.summary")
    return rows.select(
        "execution_id",
        F.coalesce(stored["total_tests"], total()).alias("total_tests"),
        F.coalesce(stored["passed"], having("PASS")).alias("passed"),
        F.coalesce(stored["failed"], having("FAIL")).alias("failed"),
        F.coalesce(stored["errors"], having("ERROR")).alias("errors"),
    )


def history_rows(run_results: DataFrame, mappings: DataFrame, execution_id: str) -> DataFrame:
    """Rows of the per-check history for one run."""
    about = mappings.select(
        "mapping_id",
        F.col("file_row_count").alias("source_row_count"),
        F.col("table_row_count").alias("target_row_count"),
        "execution_time_ms",
    )
    return run_results.join(about, "mapping_id", "left").select(
        F.lit(execution_id).alias("execution_id"),
        "mapping_id", "test_id", "test_name", "status", "rows_affected", "error_message",
        "execution_time_ms", "source_row_count", "target_row_count",
    )


def run_record(
    run_results: DataFrame,
    mappings: DataFrame,
    mode: str,
    source: str,
    target: str,
    project_id: str | None = None,
    suggestions: DataFrame | None = None,
    legacy_rules: bool = False,
) -> DataFrame:
    """The row of the run history for one run; its details JSON holds the summary.

    What each mapping found is kept by `run_details`, one row for each.
    """
    if mode == "schema":
        raise ValueError("a run over schemas is recorded by schema_record")
    errors = mappings.agg(F.count("error").alias("mapping_errors"))
    summary = suite_summary(run_results, mappings, suggestions).withColumn(
        "mapping_errors", errors.scalar()
    )
    counted = ("total_mappings", "total_tests", "passed", "failed", "errors", "total_suggestions")
    details = F.to_json(F.struct(F.struct(*counted).alias("summary")))
    return run_status(summary, mode, legacy_rules).select(
        *_run_columns(project_id, mode, source, target),
        "total_tests",
        F.col("passed").alias("passed_tests"),
        F.col("failed").alias("failed_tests"),
        details.alias("details"),
    )


def _run_columns(project_id: str | None, mode: str, source: str, target: str) -> list[Column]:
    return [
        F.lit(project_id).alias("project_id"),
        F.lit(MODES[mode]).alias("comparison_mode"),
        F.lit(source).alias("source"),
        F.lit(target).alias("target"),
        F.col("run_status").alias("status"),
    ]


def schema_record(
    summary: DataFrame, source: str, target: str, project_id: str | None = None
) -> DataFrame:
    """The row of the run history for a run over schemas.

    summary: total_tables and total_issues (see `schema_summary`); tables count as tests
    and issues as failed, so a table with several issues counts as often.
    """
    details = F.to_json(F.struct(F.struct("total_tables", "total_issues").alias("summary")))
    return run_status(summary, "schema").select(
        *_run_columns(project_id, "schema", source, target),
        F.col("total_tables").alias("total_tests"),
        F.greatest(F.col("total_tables") - F.col("total_issues"), F.lit(0)).alias("passed_tests"),
        F.col("total_issues").alias("failed_tests"),
        details.alias("details"),
    )


def run_details(
    run_results: DataFrame,
    mappings: DataFrame,
    execution_id: str,
    suggestions: DataFrame | None = None,
) -> DataFrame:
    """A row for each mapping of a run: row counts, error, results and suggestions as JSON.

    What is gathered in a row are the checks of one mapping.
    """

    def listed(rows: DataFrame, name: str) -> DataFrame:
        fields = F.struct(*(c for c in rows.columns if c != "mapping_id"))
        found = F.to_json(F.sort_array(F.collect_list(fields)))
        return rows.groupBy("mapping_id").agg(found.alias(name))

    out = mappings.join(listed(run_results, "predefined_results"), "mapping_id", "left")
    if suggestions is None:
        out = out.withColumn("suggestions", F.lit(None).cast("string"))
    else:
        out = out.join(listed(suggestions, "suggestions"), "mapping_id", "left")
    return out.select(
        F.lit(execution_id).alias("execution_id"), "mapping_id", "source", "target", "error",
        F.col("file_row_count").alias("source_row_count"),
        F.col("table_row_count").alias("target_row_count"),
        F.coalesce("predefined_results", F.lit("[]")).alias("predefined_results"),
        F.coalesce("suggestions", F.lit("[]")).alias("suggestions"),
    )
