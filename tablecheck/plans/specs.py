"""From configuration rows to the checks to run and their parameters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.typing import NUMBER_KINDS
from . import registry

# Column names taken to be a key when none is configured.
KEY_NAMES = ("id", "key", "uuid", "guid")

CONFIG_TYPES = {
    "numeric_range": ("numeric_range_checks", "map<string,struct<min:string,max:string>>"),
    "date_range": ("date_range_checks", "map<string,struct<min_date:string,max_date:string>>"),
    "referential_integrity": (
        "foreign_key_checks",
        "map<string,struct<`table`:string,`column`:string>>",
    ),
    "pattern_validation": ("pattern_checks", "map<string,string>"),
}

_SPEC = {
    "min": "double", "max": "double", "min_date": "string", "max_date": "string",
    "pattern": "string", "ref_table": "string", "ref_column": "string",
}
_SPEC_FIELDS = {
    "numeric_range": {"min": "min", "max": "max"},
    "date_range": {"min_date": "min_date", "max_date": "max_date"},
    "referential_integrity": {"ref_table": "table", "ref_column": "column"},
}


def decode(config: DataFrame, check: str) -> Column:
    """The JSON settings of one check as a map; already decoded ones are kept."""
    name, ddl = CONFIG_TYPES[check]
    if isinstance(config.schema[name].dataType, T.MapType):
        return F.col(name)
    return F.from_json(name, ddl)


def _has_settings(config: DataFrame, name: str) -> Column:
    """Whether JSON settings name any column; only their keys are read."""
    if isinstance(config.schema[name].dataType, T.MapType):
        return F.size(name) > 0
    return F.size(F.json_object_keys(name)) > 0


def check_specs(config: DataFrame) -> DataFrame:
    """One row per mapping, check and column, with that check's parameters.

    The settings of a mapping are exploded together, in one pass over the table.
    """

    def entries(check: str) -> Column:
        def spec(entry: Column) -> Column:
            value = entry["value"]
            given = {k: value[v] for k, v in _SPEC_FIELDS.get(check, {}).items()}
            if check == "pattern_validation":
                given = {"pattern": value}
            return F.struct(
                F.lit(check).alias("test_id"),
                entry["key"].alias("column_name"),
                # a number may be written as text; one that is not a number is NULL
                *(given.get(k, F.lit(None)).try_cast(t).alias(k) for k, t in _SPEC.items()),
            )

        found = F.transform(F.map_entries(decode(config, check)), spec)
        return F.coalesce(found, F.array().cast(_ENTRY_ARRAY))

    everything = F.concat(*(entries(check) for check in CONFIG_TYPES))
    return config.select("mapping_id", F.inline(everything))


_ENTRY_ARRAY = (
    "array<struct<test_id:string,column_name:string,"
    + ",".join(f"{k}:{t}" for k, t in _SPEC.items())
    + ">>"
)


def broken_settings(config: DataFrame) -> DataFrame:
    """(mapping_id, setting) of JSON settings that do not parse."""
    found = F.array(
        *(
            F.when(F.col(name).isNotNull() & decode(config, check).isNull(), F.lit(name))
            for check, (name, _) in CONFIG_TYPES.items()
        )
    )
    return config.select("mapping_id", F.explode(F.array_compact(found)).alias("setting"))


def _listed(config: DataFrame, *keep: Column | str) -> DataFrame:
    """Listed checks in order, or the global ones if none; the registry's eight rows
    are broadcast, which also drops unknown ids."""
    defaults = F.array(*(F.lit(c.test_id) for c in registry.CHECKS if c.is_global))
    ids = F.when(F.size("enabled_test_ids") > 0, F.col("enabled_test_ids")).otherwise(defaults)
    listed = config.select("mapping_id", *keep, F.posexplode(ids).alias("position", "test_id"))
    known = registry.frame(config.sparkSession).drop("ordinal")
    return listed.join(F.broadcast(known), "test_id")


def enabled_checks(config: DataFrame) -> DataFrame:
    """(mapping_id, position, test_id, ...): a repeated id runs twice."""
    return _listed(config).select(
        "mapping_id", "position", "test_id", "test_name", "test_category", "severity",
        "description", "is_global",
    )


def planned_checks(config: DataFrame) -> DataFrame:
    """The checks that will run: the row count first and always, then the enabled ones
    that have something to check. Inferred settings are expected to be filled in.

    One pass over the configuration, without a shuffle.
    """
    lists = {
        "no_nulls_required": "required_columns",
        "no_duplicates_pk": "primary_key_columns",
        "outlier_detection": "outlier_columns",
    }
    # The branches are tried in turn, so a row parses no more than its own setting.
    applies = F.lit(False)
    for check, name in lists.items():
        applies = F.when(F.col("test_id") == check, F.size(name) > 0).otherwise(applies)
    for check, (name, _) in CONFIG_TYPES.items():
        applies = F.when(F.col("test_id") == check, _has_settings(config, name)).otherwise(applies)
    used = [*lists.values(), *(name for name, _ in CONFIG_TYPES.values())]
    kept = _listed(config, *used).where(applies)
    first = registry.BY_ID["row_count_match"]
    always = config.select(
        "mapping_id",
        F.lit(0).alias("position"),
        F.lit(first.test_id).alias("test_id"),
        F.lit(first.severity).alias("severity"),
    )
    return always.unionByName(
        kept.select(
            "mapping_id", (F.col("position") + 1).alias("position"), "test_id", "severity"
        )
    )


def infer_settings(targets: DataFrame, columns: DataFrame) -> DataFrame:
    """Key, required and outlier columns of every mapping that lists none.

    targets: (mapping_id, target_table); columns: see `sources.tables.columns`. Both
    are as large as the configuration and the schemas, never as the data.
    """
    name = F.lower("column_name")
    is_key = name.isin(*KEY_NAMES) | (name == F.concat("target_table", F.lit("_id")))

    def gather(test: Column) -> Column:
        found = F.collect_list(F.when(test, F.struct("position", "column_name")))
        return F.transform(F.array_sort(found), lambda x: x["column_name"])

    return (
        targets.join(columns, targets["target_table"] == columns["table_name"])
        .groupBy("mapping_id")
        .agg(
            gather(is_key).alias("primary_key_columns"),
            gather(F.col("mode") == "REQUIRED").alias("required_columns"),
            gather(F.col("kind").isin(*sorted(NUMBER_KINDS))).alias("outlier_columns"),
        )
    )


def infer_key(target_table: str, names: Iterable[str]) -> list[str]:
    """The key of one table; the table's name counts as written, not lower-cased."""
    wanted = {*KEY_NAMES, f"{target_table}_id"}
    return [n for n in names if n.lower() in wanted]
