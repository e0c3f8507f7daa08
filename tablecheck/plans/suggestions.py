"""Suggesting further checks from what the loaded data looks like."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, functions as F

from ..functions import regex
from ..functions.sqltext import number_literal, quote_part, quote_table, string_literal
from ..functions.typing import NUMBER_KINDS, STRING, field_type, is_id_name
from ..operators.conditions import conditions
from ..operators.dependencies import repeated_values
from ..operators.patterns import accepted, learned_patterns, violates
from ..operators.profile import SHAPES, column_profile
from ..operators.quantiles import robust_ranges
from ..operators.rowchecks import fused_counts
from ..session import local_frame

SCHEMA = (
    "mapping_id string, column_name string, test_name string, test_category string,"
    " severity string, sql_query string, reasoning string, estimated_failures bigint"
)

# Distinct values are first estimated with a standard error of 5 %. A column whose estimate
# is within this factor of a limit is counted exactly, and the exact number decides.
MARGIN = 1.25
# Kinds of column that may identify a row.
KEY_KINDS = frozenset({"INTEGER", "NUMERIC", STRING})


@dataclass
class _Rule:
    column: str
    name: str
    category: str
    severity: str
    reasoning: str
    predicate: str | None = None  # None: uniqueness, counted by grouping


def _is_measure(p: Row) -> bool:
    """Whether a column's numbers are quantities rather than identifiers."""
    key_like = p.kind in KEY_KINDS and p.approx_distinct * MARGIN >= p.n_values
    return p.kind in NUMBER_KINDS and bool(p.n_values) and not key_like and not is_id_name(p.column_name)


def _rules(
    df: DataFrame, profile: list[Row], codes: dict[str, list[str]], ranges: dict[str, tuple]
) -> list[_Rule]:
    rules = []
    for p in profile:
        name, column = p.column_name, quote_part(p.column_name)
        if not p.n_values:
            continue
        key_like = p.kind in KEY_KINDS and p.approx_distinct * MARGIN >= p.n_values
        if not p.n_nulls:
            rules.append(_Rule(name, f"{name} is never NULL", "completeness", "MEDIUM",
                               f"none of {p.rows} rows lacks {name}", f"{column} IS NULL"))
        if key_like and not p.n_nulls:
            rules.append(_Rule(name, f"{name} is unique", "integrity", "HIGH",
                               f"{name} has a different value in every row"))
        if _is_measure(p):
            data_type = field_type(df.schema, name)
            ends = ranges.get(name, (p.min_value, p.max_value))
            try:
                low, high = (number_literal(v, data_type) for v in ends)
            except (ValueError, ArithmeticError):  # NaN or infinity among the values
                continue
            rules.append(_Rule(name, f"{name} stays in its range", "quality", "MEDIUM",
                               f"{name} lies in {ends[0]} .. {ends[1]}",
                               f"{column} < {low} OR {column} > {high}"))
        for shape, pattern in SHAPES.items():
            if p.kind == STRING and p[f"n_{shape}"] == p.n_values:
                java = string_literal(regex.to_java(pattern))
                rules.append(_Rule(name, f"{name} looks like {shape}", "quality", "MEDIUM",
                                   f"all {p.n_values} values of {name} look like {shape}",
                                   f"NOT {column} RLIKE {java}"))
        if name in codes:
            listed = ", ".join(string_literal(v) for v in codes[name])
            rules.append(_Rule(name, f"{name} is a known code", "business", "LOW",
                               f"{name} has {len(codes[name])} values",
                               f"{column} NOT IN ({listed})"))
    return rules


def _codes(df: DataFrame, profile: list[Row], max_codes: int) -> dict[str, list[str]]:
    """Values of text columns that have at most `max_codes`; one scan of those columns."""
    names = [
        p.column_name for p in profile
        if p.kind == STRING and p.n_values and p.approx_distinct <= MARGIN * max_codes
    ]
    if not names:
        return {}
    sets = df.agg(
        *(F.array_sort(F.collect_set(quote_part(c))).alias(f"s{i}") for i, c in enumerate(names))
    ).first()
    return {c: values for c, values in zip(names, sets) if len(values) <= max_codes}


def _condition_rules(df: DataFrame) -> list[_Rule]:
    return [
        _Rule(r.columns, r.condition, "business", "MEDIUM", f"all {r.rows_checked} rows obey it", r.violation)
        for r in conditions(df).collect()
    ]


def _pattern_rules(df: DataFrame, profile: list[Row], codes: Iterable[str]) -> list[_Rule]:
    """A rule for each text column without a known shape or codes whose values follow few
    patterns."""
    names = [
        p.column_name for p in profile
        if p.kind == STRING and p.n_values and p.column_name not in codes
        and all(p[f"n_{shape}"] < p.n_values for shape in SHAPES)
    ]
    if not names:
        return []
    found: dict[str, list[tuple[str, int]]] = {}
    few = learned_patterns(df, names).groupBy("column_name").agg(  # at most 1,000 of a column
        F.slice(F.sort_array(F.collect_list(F.struct("n_values", "pattern")), asc=False), 1, 1000).alias("top"),
        F.sum("n_values").alias("n"),
    )
    for row in few.collect():
        found[row.column_name] = [(x.pattern, x.n_values) for x in row.top]
    rules = []
    for name in names:
        pattern = accepted(found.get(name, []))
        if pattern:
            rules.append(_Rule(name, f"{name} follows its pattern", "quality", "MEDIUM",
                               f"values of {name} follow {pattern}",
                               violates(quote_part(name), pattern)))
    return rules


def suggest_checks(
    mapping_id: str,
    target: DataFrame,
    target_name: str,
    learn_from: DataFrame | None = None,
    already: Iterable[tuple[str, str]] = (),
    max_codes: int = 20,
    learn_patterns: bool = False,
    learn_conditions: bool = False,
    robust: bool = False,
) -> DataFrame:
    """Checks that hold for `learn_from` (the source, or the target itself) and how many
    rows of the target fail them.

    already: (column, category) pairs that need no suggestion. max_codes: a text column
    with at most that many values is taken to be a list of codes. The rows collected on
    the way are one per column. Uniqueness is only suggested where it is exact.
    learn_patterns: also suggest the patterns that text columns are found to follow.
    learn_conditions: also suggest the conditions that pairs of columns obey in every row.
    robust: far values of the basis do not widen the suggested ranges.
    """
    basis = target if learn_from is None else learn_from
    spark = target.sparkSession
    profile = column_profile(basis).collect()
    skip = set(already)
    codes = _codes(basis, profile, max_codes)
    measures = [p.column_name for p in profile if _is_measure(p)] if robust else []
    rules = _rules(basis, profile, codes, robust_ranges(basis, measures))
    if learn_conditions:
        rules += _condition_rules(basis)
    if learn_patterns:
        rules += _pattern_rules(basis, profile, codes)
    rules = [r for r in rules if (r.column, r.category) not in skip]
    keys = [r for r in rules if r.predicate is None]
    if keys:
        repeats = repeated_values(basis, [r.column for r in keys])
        rules = [r for r in rules if r.predicate or not repeats[r.column]]
    predicates = {str(i): r.predicate for i, r in enumerate(rules) if r.predicate}
    failures = {r.metric: r.value for r in fused_counts(target, predicates).collect()}
    repeats = repeated_values(target, [r.column for r in rules if r.predicate is None])
    failures |= {str(i): repeats[r.column] for i, r in enumerate(rules) if r.predicate is None}
    table = quote_table(target_name)

    def query(r: _Rule) -> str:
        if r.predicate:
            return f"SELECT * FROM {table} WHERE {r.predicate}"
        c = quote_part(r.column)
        return f"SELECT {c}, count(*) AS n FROM {table} GROUP BY {c} HAVING count(*) > 1"

    return local_frame(
        spark,
        [
            (mapping_id, r.column, r.name, r.category, r.severity, query(r), r.reasoning,
             failures[str(i)])
            for i, r in enumerate(rules)
        ],
        SCHEMA,
    )
