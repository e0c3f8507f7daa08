"""The service's own tables: configuration, custom checks, suggestions, histories.

All are append-only parquet. A change never rewrites a row: it appends the next
version of the record, and readers keep the latest version of every key. Losing an
executor or a whole run therefore leaves earlier rows as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from ..session import local_frame


_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


CONFIG = _schema(
    mapping_id="string",
    mapping_name="string",
    description="string",
    source_bucket="string",
    source_file_path="string",
    source_file_format="string",
    target_dataset="string",
    target_table="string",
    primary_key_columns="strings",
    required_columns="strings",
    date_columns="strings",
    numeric_range_checks="string",
    date_range_checks="string",
    foreign_key_checks="string",
    pattern_checks="string",
    outlier_columns="strings",
    enabled_test_ids="strings",
    auto_suggest="boolean",
    is_active="boolean",
    created_at="timestamp",
    created_by="string",
    updated_at="timestamp",
    updated_by="string",
    # How to read the source; NULL means all files, a glob, one row per line.
    source_files="string",
    source_pattern_mode="string",
    source_multiline="boolean",
)
CHECK_DEFINITIONS = _schema(
    test_id="string",
    test_name="string",
    test_category="string",
    severity="string",
    description="string",
    sql_template="string",
    is_global="boolean",
    is_system="boolean",
    created_at="timestamp",
    created_by="string",
    updated_at="timestamp",
)
SUGGESTIONS = _schema(
    suggestion_id="string",
    mapping_id="string",
    test_name="string",
    test_category="string",
    severity="string",
    sql_query="string",
    reasoning="string",
    estimated_failures="long",
    status="string",
    reviewed_by="string",
    reviewed_at="timestamp",
    review_notes="string",
    suggested_at="timestamp",
    suggested_by="string",
)
CHECK_HISTORY = _schema(
    execution_id="string",
    mapping_id="string",
    test_id="string",
    test_name="string",
    status="string",
    rows_affected="long",
    error_message="string",
    execution_time_ms="long",
    source_row_count="long",
    target_row_count="long",
    executed_at="timestamp",
    executed_by="string",
)
RUN_HISTORY = _schema(
    execution_id="string",
    timestamp="timestamp",
    project_id="string",
    comparison_mode="string",
    source="string",
    target="string",
    status="string",
    total_tests="long",
    passed_tests="long",
    failed_tests="long",
    details="string",
)
# One row for each mapping of a run: what it found, kept apart from the run's own row so
# that neither grows with the number of mappings.
RUN_DETAILS = _schema(
    execution_id="string",
    mapping_id="string",
    source="string",
    target="string",
    error="string",
    source_row_count="long",
    target_row_count="long",
    predefined_results="string",
    suggestions="string",
    executed_at="timestamp",
)

CUSTOM_CHECKS = _schema(
    test_id="string",
    created_at="timestamp",
    test_name="string",
    test_category="string",
    severity="string",
    sql_query="string",
    description="string",
    target_dataset="string",
    target_table="string",
    is_active="boolean",
)

_VERSION, _WRITTEN, _TAG, _DATE = "record_version", "record_written", "record_tag", "run_month"
#: Which of two rows of a record is newer: its version; of equal versions, which concurrent
#: writers can give, the one written later; of those, either, but the same for every reader.
_ORDER = (_VERSION, _WRITTEN, _TAG)


@dataclass(frozen=True)
class Store:
    """One table below `path`.

    `key` names the column that identifies a record; `date_column` the timestamp whose
    month partitions the files, so that `newest` prunes the rest. Years of days would be
    thousands of folders for a few rows each.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str | None = None
    date_column: str | None = None

    def _shaped(self, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
        """Rows with every column of the schema, missing or NULL ones from `defaults`."""
        out = []
        for f in self.schema.fields:
            value = F.col(f.name) if f.name in rows.columns else F.lit(None)
            if f.name in defaults:
                value = F.coalesce(value, defaults[f.name])
            out.append(value.cast(f.dataType).alias(f.name))
        if self.key:
            version = F.col(_VERSION) if _VERSION in rows.columns else F.lit(1)
            out.append(version.cast("long").alias(_VERSION))
            out += [F.current_timestamp().alias(_WRITTEN), F.uuid().alias(_TAG)]
        return rows.select(*out)

    def append(self, rows: DataFrame, **defaults: Column) -> None:
        """Write rows as they are; each month's go to few files, a large one's to several."""
        shaped = self._shaped(rows, defaults)
        writer = shaped.write.mode("append")
        if self.date_column:
            shaped = shaped.withColumn(_DATE, F.trunc(self.date_column, "month"))
            shaped = shaped.hint("rebalance", F.col(_DATE))
            writer = shaped.write.mode("append").partitionBy(_DATE)
        writer.parquet(self.path)

    def add(self, rows: DataFrame, **defaults: Column) -> None:
        """Append records as the newest version of their key.

        A key given twice is refused: neither row would be the right one to keep.
        """
        if self.key in rows.columns:
            named = rows.where(F.col(self.key).isNotNull())
            twice = named.groupBy(self.key).count().where("count > 1").limit(5).collect()
            if twice:
                raise ValueError(f"{self.key} given more than once: {[r[0] for r in twice]}")
            last = self.versions().groupBy(self.key).agg(F.max(_VERSION).alias(_VERSION))
            version = F.coalesce(F.col(_VERSION), F.lit(0)) + 1
            rows = rows.join(last, self.key, "left").withColumn(_VERSION, version)
        self.append(rows, **defaults)

    def versions(self) -> DataFrame:
        """Every row ever appended; no rows before the first append."""
        schema = T.StructType(list(self.schema.fields))
        if self.key:
            schema = schema.add(_VERSION, "long").add(_WRITTEN, "timestamp").add(_TAG, "string")
        if self.date_column:
            schema = schema.add(_DATE, "date")
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return local_frame(self.spark, [], schema)

    def read(self) -> DataFrame:
        """The latest version of every record; all rows where there is no key."""
        return self._latest().drop(_VERSION) if self.key else self.versions().drop(_DATE)

    def newest(self, limit: int, condition: Column | str = "true") -> DataFrame:
        """At least the `limit` newest rows that meet the condition, whole months at a time.

        Rows are counted by month first, without reading more than the condition needs; then
        only the files of the months that reach `limit` are read.
        """
        rows = self.versions().where(condition)
        months = rows.groupBy(_DATE).count().orderBy(F.desc(_DATE)).collect()  # a row for each
        found, first = 0, None
        for month in months:
            found, first = found + month["count"], month[_DATE]
            if found >= limit:
                break
        return rows.where(F.col(_DATE) >= F.lit(first)).drop(_DATE)

    def _latest(self) -> DataFrame:
        names = [f.name for f in self.schema.fields] + [_VERSION]
        last = F.max_by(F.struct(*names), F.struct(*_ORDER)).alias("last")
        return self.versions().groupBy(self.key).agg(last).select("last.*")

    def change(self, condition: Column | str, **changes: Column) -> None:
        """Append a changed version of every current record that meets `condition`."""
        picked = self._latest().where(condition)
        self.append(picked.withColumns({**changes, _VERSION: F.col(_VERSION) + 1}))


def config_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, CONFIG, key="mapping_id")


def add_mappings(store: Store, rows: DataFrame) -> None:
    """Store mappings; one that is there already, also if switched off, is replaced."""
    now = F.current_timestamp()
    store.add(
        rows, auto_suggest=F.lit(True), is_active=F.lit(True), created_at=now, updated_at=now
    )


def active_mappings(config: DataFrame) -> DataFrame:
    """Mappings switched on; one whose flag is NULL is not."""
    return config.where("is_active")


def set_mapping_active(store: Store, mapping_id: str, active: bool) -> None:
    store.change(
        F.col("mapping_id") == mapping_id,
        is_active=F.lit(active),
        updated_at=F.current_timestamp(),
    )


def check_definition_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, CHECK_DEFINITIONS, key="test_id")


def seed_check_definitions(store: Store, definitions: DataFrame) -> None:
    """Store check definitions, usually `registry.frame`, that are not there yet."""
    new = definitions.join(store.read(), "test_id", "left_anti")
    now = F.current_timestamp()
    store.append(
        new, is_system=F.lit(True), created_at=now, created_by=F.lit("system"), updated_at=now
    )


def custom_check_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, CUSTOM_CHECKS, key="test_id")


def add_custom_checks(store: Store, rows: DataFrame) -> None:
    store.append(
        rows,
        test_id=F.uuid(),
        created_at=F.current_timestamp(),
        is_active=F.lit(True),
    )


def active_custom_checks(checks: DataFrame, target_table: str | None = None) -> DataFrame:
    active = checks.where("is_active")
    return active if target_table is None else active.where(F.col("target_table") == target_table)


def suggestion_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, SUGGESTIONS, key="suggestion_id")


def add_suggestions(store: Store, rows: DataFrame, suggested_by: str = "profile") -> None:
    store.append(
        rows,
        suggestion_id=F.uuid(),
        status=F.lit("pending"),
        suggested_at=F.current_timestamp(),
        suggested_by=F.lit(suggested_by),
    )


def pending_suggestions(suggestions: DataFrame) -> DataFrame:
    return suggestions.where("status = 'pending'")


def review_suggestions(
    store: Store,
    condition: Column | str,
    status: str,
    reviewed_by: str | None = None,
    review_notes: str | None = None,
) -> None:
    if status not in ("approved", "rejected"):
        raise ValueError(f"a review approves or rejects, not {status!r}")
    store.change(
        condition,
        status=F.lit(status),
        reviewed_by=F.lit(reviewed_by),
        reviewed_at=F.current_timestamp(),
        review_notes=F.lit(review_notes),
    )


def run_history_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, RUN_HISTORY, date_column="timestamp")


def log_runs(store: Store, rows: DataFrame) -> None:
    store.append(
        rows,
        execution_id=F.uuid(),
        timestamp=F.current_timestamp(),
        comparison_mode=F.lit("unknown"),
        source=F.lit(""),
        target=F.lit(""),
        status=F.lit("UNKNOWN"),
        total_tests=F.lit(0),
        passed_tests=F.lit(0),
        failed_tests=F.lit(0),
    )


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs first; Spark keeps `limit` rows per task and merges those."""
    return runs.orderBy(F.col("timestamp").desc(), "execution_id").limit(limit)


def newest_runs(store: Store, limit: int = 50) -> DataFrame:
    """`recent_runs` of a store, reading only the months that hold them."""
    return recent_runs(store.newest(limit), limit)


def check_history_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, CHECK_HISTORY, date_column="executed_at")


def log_checks(store: Store, rows: DataFrame) -> None:
    store.append(rows, execution_id=F.uuid(), executed_at=F.current_timestamp())


def mapping_history(checks: DataFrame, mapping_id: str, limit: int = 100) -> DataFrame:
    return (
        checks.where(F.col("mapping_id") == mapping_id)
        .orderBy(F.col("executed_at").desc(), "execution_id", "test_id")
        .limit(limit)
    )


def newest_of_mapping(store: Store, mapping_id: str, limit: int = 100) -> DataFrame:
    """`mapping_history` of a store, reading only the months that hold it."""
    rows = store.newest(limit, F.col("mapping_id") == mapping_id)
    return mapping_history(rows, mapping_id, limit)


def run_details_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, RUN_DETAILS, date_column="executed_at")


def log_run_details(store: Store, rows: DataFrame) -> None:
    store.append(rows, executed_at=F.current_timestamp())
