"""Running checks: one mapping, a suite of mappings, custom check queries.

The checks of a mapping become one Spark action: row-level checks share a single scan
of the target, the others are aggregates next to it, and all of them are united into
(metric, value) rows. Only those few rows reach the driver. If the action fails, the
checks are run one by one, so that one broken check does not hide the others.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterable, Mapping as MappingType
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from ..functions import predicates as P
from ..functions.sqltext import quote_column, quote_table, string_literal
from ..functions.typing import NUMBER_KINDS, field_type, kind_of
from ..operators import customsql
from ..operators.duplicates import no_duplicates_pk
from ..operators.outliers import SIGMAS, chosen_columns, outlier_detection
from ..operators.referential import comparable, referential_integrity
from ..operators.rowchecks import fused_counts
from ..operators.rowcount import row_count
from ..session import local_frame
from ..sources import files
from ..sources.tables import Tables
from . import registry, specs, suggestions
from .limits import jobs_of

_log = logging.getLogger(__name__)

RESULT_SCHEMA = (
    "mapping_id string, position int, test_id string, test_name string, category string,"
    " severity string, status string, rows_affected bigint, rows_violating bigint,"
    " error_message string, description string, sql_query string"
)
MAPPING_SCHEMA = (
    "mapping_id string, source string, target string, file_row_count bigint,"
    " table_row_count bigint, error string, execution_time_ms bigint"
)

SOURCE_ROWS, TARGET_ROWS = "source_rows", "target_rows"


@dataclass(frozen=True)
class Mapping:
    """One load to check: where rows came from, where they went, what must hold.

    `source` is a set of files, or any frame that stands for the loaded data.
    """

    mapping_id: str
    source: files.SourceFiles | DataFrame
    target_table: str
    primary_key_columns: tuple[str, ...] = ()
    required_columns: tuple[str, ...] = ()
    numeric_range_checks: MappingType[str, MappingType] = field(default_factory=dict)
    date_range_checks: MappingType[str, MappingType] = field(default_factory=dict)
    foreign_key_checks: MappingType[str, MappingType] = field(default_factory=dict)
    pattern_checks: MappingType[str, str] = field(default_factory=dict)
    outlier_columns: tuple[str, ...] = ()
    enabled_test_ids: tuple[str, ...] = ()
    target_dataset: str | None = None
    outlier_which: str = "first"
    auto_suggest: bool = True

    @property
    def target(self) -> str:
        return ".".join(p for p in (self.target_dataset, self.target_table) if p)

    @property
    def source_name(self) -> str:
        return self.source.location if isinstance(self.source, files.SourceFiles) else "frame"

    @classmethod
    def from_row(cls, row: Row, **extra) -> Mapping:
        """From a row of the configuration table; JSON settings may be text or maps."""
        given = row.asDict(recursive=True)

        def decoded(name: str) -> dict:
            value = given.get(name)
            return (json.loads(value) if isinstance(value, str) else value) or {}

        return cls(
            mapping_id=given["mapping_id"],
            source=files.SourceFiles(
                given["source_bucket"],
                given["source_file_path"],
                given["source_file_format"],
                files=given.get("source_files") or "all",
                pattern_mode=given.get("source_pattern_mode") or "glob",
                multiline=bool(given.get("source_multiline")),
            ),
            target_dataset=given["target_dataset"],
            target_table=given["target_table"],
            auto_suggest=given.get("auto_suggest") is not False,
            **{
                name: tuple(given.get(name) or ())
                for name in (
                    "primary_key_columns", "required_columns", "outlier_columns",
                    "enabled_test_ids",
                )
            },
            **{
                name: decoded(name)
                for name in (
                    "numeric_range_checks", "date_range_checks", "foreign_key_checks",
                    "pattern_checks",
                )
            },
            **extra,
        )


@dataclass
class Planned:
    """A check ready to be counted: a predicate on the target, or a violations frame."""

    check: registry.Check
    position: int
    predicate: str | None = None
    violations: DataFrame | None = None
    sql_query: str = ""
    error: str | None = None

    @property
    def metric(self) -> str:
        return f"{self.position}:{self.check.test_id}"


@dataclass(frozen=True)
class TableSchema:
    """What planning needs to know of a table where there is no session, as in a task."""

    schema: T.StructType

    @property
    def columns(self) -> list[str]:
        return self.schema.names


@dataclass(frozen=True)
class LoadedMapping:
    """A mapping with its target table and its settings, given or inferred. Without a
    session it can be planned, from the schemas of its tables, but not run."""

    spark: SparkSession | None
    mapping: Mapping
    target: DataFrame | TableSchema
    tables: Tables
    required: tuple[str, ...] = ()

    @property
    def table(self) -> str:
        return quote_table(self.mapping.target)

    def setting(self, name: str) -> Any:
        given = getattr(self.mapping, name)
        if given:
            return given
        if name == "primary_key_columns":
            return specs.infer_key(self.mapping.target_table, self.target.columns)
        if name == "required_columns":
            return self.required
        if name == "outlier_columns":
            fields = self.target.schema.fields
            return [f.name for f in fields if kind_of(f.dataType) in NUMBER_KINDS]
        return given

    def column(self, name: str) -> str:
        return quote_column(name, self.target.schema)


def _row_check(plan: Planned, loaded: LoadedMapping, predicate: str) -> None:
    plan.predicate = predicate
    plan.sql_query = f"SELECT * FROM {loaded.table} WHERE {predicate}"


def _no_nulls(plan: Planned, loaded: LoadedMapping, columns) -> None:
    _row_check(plan, loaded, P.null_predicate(loaded.target.schema, columns))


def _numeric_range(plan: Planned, loaded: LoadedMapping, checks) -> None:
    _row_check(plan, loaded, P.numeric_range_predicate(loaded.target.schema, checks))


def _date_range(plan: Planned, loaded: LoadedMapping, checks) -> None:
    _row_check(plan, loaded, P.date_range_predicate(loaded.spark, loaded.target.schema, checks))


def _pattern(plan: Planned, loaded: LoadedMapping, patterns) -> None:
    _row_check(plan, loaded, P.pattern_predicate(loaded.spark, loaded.target.schema, patterns))


def _duplicates(plan: Planned, loaded: LoadedMapping, key) -> None:
    for name in key:
        field_type(loaded.target.schema, name)
    if loaded.spark is not None:
        plan.violations = no_duplicates_pk(loaded.target, key)
    columns = ", ".join(loaded.column(c) for c in key)
    plan.sql_query = (
        f"SELECT {columns}, count(*) AS duplicate_count FROM {loaded.table}"
        f" GROUP BY {columns} HAVING count(*) > 1"
    )


def _referential(plan: Planned, loaded: LoadedMapping, checks) -> None:
    if loaded.spark is not None:
        plan.violations = referential_integrity(loaded.target, checks, loaded.tables)
    selects = []
    for column, ref in checks.items():
        parent = loaded.tables(ref["table"]).schema
        cast_to = comparable(
            (column, field_type(loaded.target.schema, column)),
            (ref["column"], field_type(parent, ref["column"])),
        )
        child, known = loaded.column(column), quote_column(ref["column"], parent)
        if cast_to:
            child, known = f"CAST({child} AS {cast_to})", f"CAST({known} AS {cast_to})"
        selects.append(
            f"SELECT {string_literal(column)} AS fk_column, CAST(v AS STRING) AS invalid_value,"
            f" occurrence_count FROM (SELECT {child} AS v, count(*) AS occurrence_count"
            f" FROM {loaded.table} GROUP BY 1) LEFT ANTI JOIN"
            f" (SELECT {known} AS known FROM {quote_table(ref['table'])}) ON v = known"
            f" WHERE v IS NOT NULL"
        )
    plan.sql_query = " UNION ALL ".join(selects)


def _outliers(plan: Planned, loaded: LoadedMapping, columns) -> None:
    columns = chosen_columns(columns, loaded.mapping.outlier_which)
    P.require_numbers(loaded.target.schema, columns)
    if loaded.spark is not None:
        plan.violations = outlier_detection(loaded.target, columns, "all")
    values = [f"CAST({loaded.column(c)} AS DOUBLE)" for c in columns]
    far = P.any_of(
        f"abs({v} - (SELECT avg({v}) FROM {loaded.table}))"
        f" > {SIGMAS} * (SELECT stddev_samp({v}) FROM {loaded.table})"
        for v in values
    )
    plan.sql_query = f"SELECT * FROM {loaded.table} WHERE {far}"


# Per check: the setting without which it is skipped, and how it is planned.
_PLANNERS: dict[str, tuple[str, Callable]] = {
    "no_nulls_required": ("required_columns", _no_nulls),
    "no_duplicates_pk": ("primary_key_columns", _duplicates),
    "referential_integrity": ("foreign_key_checks", _referential),
    "numeric_range": ("numeric_range_checks", _numeric_range),
    "date_range": ("date_range_checks", _date_range),
    "pattern_validation": ("pattern_checks", _pattern),
    "outlier_detection": ("outlier_columns", _outliers),
}


def plan_mapping(loaded: LoadedMapping) -> list[Planned]:
    """The checks of one mapping, without running any. A check that cannot be planned
    carries its error.

    Without a session, predicates and query texts are settled from the schemas, but there
    are no violations frames, and the engine is not asked whether it takes date bounds and
    patterns.
    """
    wanted = loaded.mapping.enabled_test_ids or [
        c.test_id for c in registry.CHECKS if c.is_global
    ]
    plans = []
    for position, test_id in enumerate(wanted, 1):
        if test_id not in _PLANNERS:
            continue  # unknown, or the row count, which always runs
        setting, planner = _PLANNERS[test_id]
        value = loaded.setting(setting)
        if not value:
            continue
        plan = Planned(registry.BY_ID[test_id], position)
        try:
            planner(plan, loaded, value)
        except Exception as e:  # whatever is wrong with one check, the others still run
            plan.error = str(e)
        plans.append(plan)
    return plans


def metrics(source: DataFrame | None, target: DataFrame, plans: Iterable[Planned]) -> DataFrame:
    """(metric, value) of everything a mapping needs, as one lazy frame."""
    plans = [p for p in plans if p.error is None]
    parts = [
        fused_counts(
            target, {p.metric: p.predicate for p in plans if p.predicate}, rows=TARGET_ROWS
        )
    ]
    parts += [row_count(p.violations, p.metric) for p in plans if p.violations is not None]
    if source is not None:
        parts.append(row_count(source, SOURCE_ROWS))
    return reduce(DataFrame.unionByName, parts)


# What the messages of lost executors, cancelled jobs and ended sessions contain.
_ENGINE_FAILURES = (
    "ExecutorLostFailure", "OutOfMemoryError", "was cancelled", "SparkContext was shut down",
    "FetchFailed", "stopped SparkContext",
)


def is_engine_failure(error: Exception) -> bool:
    """Whether the cluster failed rather than a check or its data."""
    return any(x in str(error) for x in _ENGINE_FAILURES)


def _counted(source: DataFrame | None, target: DataFrame, plans: list[Planned]) -> dict:
    """Values by metric. A check that fails is marked on its plan and has no value.

    Only what may be the data's or a check's fault is tried again in smaller parts. If
    the cluster fails, running the same scans once more would not help.
    """

    def collect(frame: DataFrame) -> dict:
        return {r.metric: r.value for r in frame.collect()}

    planned = [p for p in plans if p.error is None]
    try:
        return collect(metrics(source, target, planned))
    except Exception as e:  # find out which; the row checks share their scan if they can
        if is_engine_failure(e):
            raise
        _log.warning("checks failed together and are run apart", exc_info=True)
    rows = [p for p in planned if p.predicate]
    alone = [p for p in planned if not p.predicate]
    try:
        found = collect(metrics(source, target, rows))
    except Exception as e:
        if is_engine_failure(e):
            raise
        _log.warning("row checks failed together and are run apart", exc_info=True)
        found = collect(metrics(source, target, []))
        alone = planned
    for p in alone:
        try:
            if p.predicate:
                found[p.metric] = collect(metrics(None, target, [p]))[p.metric]
            else:
                found.update(collect(row_count(p.violations, p.metric)))
        except Exception as e:
            p.error = str(e)
    return found


def _result(
    mapping_id: str, p: Planned, violating: int | None, report_cap: int | None
) -> tuple:
    c = p.check
    reported = violating or 0
    if report_cap is not None and c.test_id not in registry.UNCAPPED:
        reported = min(reported, report_cap)
    status = "ERROR" if p.error else "PASS" if violating == 0 else "FAIL"
    return (
        mapping_id, p.position, c.test_id, c.test_name, c.category, c.severity, status,
        reported, violating or 0, p.error, c.description, p.sql_query,
    )


def _row_count_result(mapping_id: str, source_rows: int, target_rows: int) -> tuple:
    c = registry.BY_ID["row_count_match"]
    difference = abs(source_rows - target_rows)
    return (
        mapping_id, 0, c.test_id, c.test_name, c.category, c.severity,
        "FAIL" if difference else "PASS", difference, difference,
        f"Row count mismatch: {difference} rows difference" if difference else None,
        f"Source: {source_rows} rows, target: {target_rows} rows", "",
    )


@dataclass(frozen=True)
class Run:
    """Results (one row per check), mappings (one row each, with its error) and the
    suggested further checks."""

    results: DataFrame
    mappings: DataFrame
    suggestions: DataFrame


@dataclass
class _Outcome:
    about: tuple
    results: list[tuple] = field(default_factory=list)
    suggestions: list[tuple] = field(default_factory=list)

    def stopped(self, error: str) -> _Outcome:
        """What is left of a mapping whose time was over: who it was, and the error."""
        *about, _, elapsed = self.about
        return _Outcome((*about[:3], None, None, error, elapsed))


def _as_run(spark: SparkSession, outcomes: Iterable[_Outcome]) -> Run:
    outcomes = list(outcomes)
    return Run(
        local_frame(spark, [r for o in outcomes for r in o.results], RESULT_SCHEMA),
        local_frame(spark, [o.about for o in outcomes], MAPPING_SCHEMA),
        local_frame(spark, [r for o in outcomes for r in o.suggestions], suggestions.SCHEMA),
    )


def _suggested(loaded: LoadedMapping) -> list[tuple]:
    """Suggestions learnt from the source; failing to suggest is not an error."""
    mapping, target = loaded.mapping, loaded.target
    try:
        source = mapping.source
        if isinstance(source, files.SourceFiles):
            source = files.read_as(loaded.spark, source, target.schema)
        already = [(c, "completeness") for c in loaded.setting("required_columns")]
        key = loaded.setting("primary_key_columns")
        already += [(key[0], "integrity")] if len(key) == 1 else []
        already += [(c, "quality") for c in (*mapping.numeric_range_checks, *mapping.pattern_checks)]
        found = suggestions.suggest_checks(
            mapping.mapping_id, target, mapping.target, source, already
        )
        return [tuple(r) for r in found.collect()]  # a few per column
    except Exception:
        _log.exception("no suggestions for mapping %s", mapping.mapping_id)
        return []


def _run_one(
    spark: SparkSession,
    mapping: Mapping,
    tables: Tables,
    required: Iterable[str],
    report_cap: int | None,
) -> _Outcome:
    started = time.monotonic()

    def about(source_rows=None, target_rows=None, error=None) -> tuple:
        elapsed = int((time.monotonic() - started) * 1000)
        return (mapping.mapping_id, mapping.source_name, mapping.target, source_rows,
                target_rows, error, elapsed)

    try:
        loaded = LoadedMapping(spark, mapping, tables(mapping.target), tables, tuple(required))
        from_files = isinstance(mapping.source, files.SourceFiles)
        source_rows = files.row_count(spark, mapping.source) if from_files else None
        plans = plan_mapping(loaded)
        found = _counted(None if from_files else mapping.source, loaded.target, plans)
        if source_rows is None:
            source_rows = found[SOURCE_ROWS]
        target_rows = found[TARGET_ROWS]
        rows = [_row_count_result(mapping.mapping_id, source_rows, target_rows)]
        rows += [_result(mapping.mapping_id, p, found.get(p.metric), report_cap) for p in plans]
        suggested = _suggested(loaded) if mapping.auto_suggest else []
        return _Outcome(about(source_rows, target_rows), rows, suggested)
    except Exception as e:  # a mapping that cannot be read has an error and no results
        return _Outcome(about(error=str(e)))


def _run_all(
    spark: SparkSession,
    mappings: list[Mapping],
    tables: Tables,
    required: MappingType[str, Iterable[str]] | None,
    parallel: int,
    report_cap: int | None,
    time_limit: float | None,
) -> list[_Outcome]:
    required = required or {}

    def run(mapping: Mapping) -> _Outcome:
        with jobs_of(spark, mapping.mapping_id, time_limit) as limit:
            found = _run_one(spark, mapping, tables, required.get(mapping.target, ()), report_cap)
        return found.stopped(limit.message()) if limit.over else found

    if parallel > 1 and len(mappings) > 1:
        with ThreadPoolExecutor(parallel) as pool:
            return list(pool.map(inheritable_thread_target(spark)(run), mappings))
    return [run(m) for m in mappings]


def run_suite(
    spark: SparkSession,
    mappings: Iterable[Mapping],
    tables: Tables,
    required: MappingType[str, Iterable[str]] | None = None,
    parallel: int = 4,
    report_cap: int | None = None,
    time_limit: float | None = None,
) -> Run:
    """Run every mapping, `parallel` of them at a time on one cluster.

    required: columns that must be filled, by table, where a mapping names none.
    report_cap: the most rows that `rows_affected` of a row-level check reports, if it
    is to be limited; `rows_violating` is the full number in any case.
    time_limit: the seconds a mapping may take; one that takes longer is stopped and has an
    error, the others go on. Each has a scheduler pool of its own.
    """
    mappings = list(mappings)
    if not mappings:
        raise ValueError("no active mappings")
    return _as_run(spark, _run_all(spark, mappings, tables, required, parallel, report_cap, time_limit))


def run_mapping(
    spark: SparkSession,
    mapping: Mapping,
    tables: Tables,
    required: Iterable[str] = (),
    report_cap: int | None = None,
) -> Run:
    return run_suite(spark, [mapping], tables, {mapping.target: required}, 1, report_cap)


def run_single_file(
    spark: SparkSession,
    source: files.SourceFiles | DataFrame,
    target: str,
    tables: Tables,
    required: Iterable[str] = (),
    enabled_test_ids: Iterable[str] = (),
    auto_suggest: bool = True,
    report_cap: int | None = None,
) -> Run:
    """Compare one file, or a pattern of files, with one table."""
    dataset, _, table = target.rpartition(".")
    mapping = Mapping(
        "single_file_comparison",
        source,
        table,
        target_dataset=dataset or None,
        enabled_test_ids=tuple(enabled_test_ids) or registry.SINGLE_FILE_CHECKS,
        auto_suggest=auto_suggest,
    )
    return run_mapping(spark, mapping, tables, required, report_cap)


def run_config(
    spark: SparkSession,
    config: DataFrame,
    tables: Tables,
    required: MappingType[str, Iterable[str]] | None = None,
    parallel: int = 4,
    report_cap: int | None = None,
    time_limit: float | None = None,
) -> Run:
    """Run the active mappings of a configuration table.

    The configuration is read row by row: it grows with the number of loads, not
    with their data. A row that cannot be understood is reported as its own error.
    """
    good, bad = [], []
    for row in config.where("is_active").toLocalIterator():
        try:
            good.append(Mapping.from_row(row))
        except Exception as e:
            bad.append(_Outcome((row.mapping_id, None, row.target_table, None, None, str(e), 0)))
    if not good and not bad:
        raise ValueError("no active mappings")
    ran = _run_all(spark, good, tables, required, parallel, report_cap, time_limit)
    return _as_run(spark, ran + bad)


def mapping_metrics(
    spark: SparkSession, mapping: Mapping, tables: Tables, required: Iterable[str] = ()
) -> DataFrame:
    """(metric, value) of a mapping's checks as one lazy frame, to run or explain.

    Checks that cannot be planned have no row; a source of files is counted apart.
    """
    loaded = LoadedMapping(spark, mapping, tables(mapping.target), tables, tuple(required))
    source = None if isinstance(mapping.source, files.SourceFiles) else mapping.source
    return metrics(source, loaded.target, plan_mapping(loaded))


def violations(
    spark: SparkSession,
    mapping: Mapping,
    tables: Tables,
    test_id: str,
    required: Iterable[str] = (),
) -> DataFrame:
    """All violations of one of a mapping's checks, for a closer look."""
    loaded = LoadedMapping(spark, mapping, tables(mapping.target), tables, tuple(required))
    for plan in plan_mapping(loaded):
        if plan.check.test_id == test_id:
            if plan.error:
                raise ValueError(plan.error)
            if plan.predicate:
                return P.violating_rows(loaded.target, plan.predicate)
            return plan.violations
    raise ValueError(f"{test_id!r} does not apply to mapping {mapping.mapping_id!r}")


def run_custom_checks(spark: SparkSession, checks: DataFrame) -> DataFrame:
    """Run check queries (test_id, test_name, test_category, severity, description,
    sql_query) with the pass rule; a blank query is skipped.

    Queries that Spark can analyse are counted in one action, so their stages overlap;
    if that fails, each is run on its own.
    """
    rows = [c for c in checks.toLocalIterator() if not customsql.is_blank(c.sql_query)]
    frames, errors = {}, {}
    for i, c in enumerate(rows):
        try:
            frames[i] = customsql.violation_count(spark, c.sql_query)
        except Exception as e:
            errors[i] = str(e)

    def counted(which: Iterable[int]) -> dict[int, int]:
        parts = [frames[i].select(F.lit(i).alias("i"), "rows_violating") for i in which]
        if not parts:
            return {}
        return {r.i: r.rows_violating for r in reduce(DataFrame.unionByName, parts).collect()}

    try:
        found = counted(frames)
    except Exception:
        found = {}
        for i in frames:
            try:
                found.update(counted([i]))
            except Exception as e:
                errors[i] = str(e)
    return local_frame(
        spark,
        [
            (None, i, c.test_id, c.test_name, c.test_category, c.severity,
             "ERROR" if i in errors else "PASS" if found[i] == 0 else "FAIL",
             found.get(i, 0), found.get(i, 0), errors.get(i), c.description, c.sql_query)
            for i, c in enumerate(rows)
        ],
        RESULT_SCHEMA,
    )
