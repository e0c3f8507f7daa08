"""The predefined checks as data."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import local_frame

SCHEMA = (
    "test_id string, test_name string, test_category string, severity string,"
    " description string, is_global boolean, ordinal int"
)


@dataclass(frozen=True)
class Check:
    test_id: str
    test_name: str
    category: str
    severity: str
    description: str
    is_global: bool


# Ids, names, categories, severities and descriptions of the checks.
CHECKS = (
    Check(
        "row_count_match", "Row Count Match", "completeness", "HIGH",
        "Verify source and target row counts match", True,
    ),
    Check(
        "no_nulls_required", "No NULLs in Required Fields", "completeness", "HIGH",
        "Check required columns have no NULL values", True,
    ),
    Check(
        "no_duplicates_pk", "No Duplicate Primary Keys", "integrity", "HIGH",
        "Ensure primary key uniqueness", True,
    ),
    Check(
        "referential_integrity", "Referential Integrity", "integrity", "HIGH",
        "Validate foreign key relationships", False,
    ),
    Check(
        "numeric_range", "Numeric Range Validation", "quality", "MEDIUM",
        "Check numeric values are within expected ranges", False,
    ),
    Check(
        "date_range", "Date Range Validation", "quality", "MEDIUM",
        "Validate dates are within expected range", False,
    ),
    Check(
        "pattern_validation", "Pattern Validation", "quality", "MEDIUM",
        "Check string patterns (email, phone, etc.)", False,
    ),
    Check(
        "outlier_detection", "Statistical Outlier Detection", "statistical", "LOW",
        "Detect statistical outliers using standard deviation", False,
    ),
)

BY_ID = {c.test_id: c for c in CHECKS}

# Checks that report whole groups: a caller's `report_cap` does not apply to them.
UNCAPPED = frozenset({"row_count_match", "no_duplicates_pk", "referential_integrity"})

# What a comparison of one file with one table runs unless told otherwise.
SINGLE_FILE_CHECKS = ("row_count_match", "no_nulls_required", "no_duplicates_pk")


def frame(spark: SparkSession) -> DataFrame:
    """The registry in its own order, for joins and for seeding the definition table."""
    return local_frame(spark, [(*astuple(c), i) for i, c in enumerate(CHECKS)], SCHEMA)


def listing(spark: SparkSession) -> DataFrame:
    """The registry as it is shown: by category, then severity, both alphabetical."""
    return frame(spark).orderBy("test_category", "severity", "ordinal").drop("ordinal")
