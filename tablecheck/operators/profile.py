"""Column profile of a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import regex
from ..functions.sqltext import quote_part
from ..functions.typing import BYTES, NESTED_KINDS, NUMBER_KINDS, STRING, kind_of

# Shapes a text column may have throughout.
SHAPES = {
    "email": r"^[^@]+@[^@]+\.[^@]+$",
    "phone": r"^\+?[0-9]{10,15}$",
    "url": r"^https?://[^\s]+$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "integer": r"^-?[0-9]+$",
}


# Columns per aggregate: more would outgrow what Spark compiles into one method.
WIDTH = 40


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: counts, bounds, mean, deviation, approximate distinct values
    and, for text, how many values have each known shape.

    All columns are profiled together, in two aggregates over the table. Distinct-value
    sketches and bounds of text keep Spark from compiling the aggregate they are in, so
    they have their own; the rest, which is most of the work, is compiled.
    Wide tables are taken WIDTH columns at a time; each scan reads only those.
    """
    fields = list(enumerate(df.schema.fields))
    columns = {i: F.col(quote_part(f.name)) for i, f in fields}
    kinds = {i: kind_of(f.dataType) for i, f in fields}
    fixed_width = {i for i, k in kinds.items() if k not in NESTED_KINDS | {STRING, BYTES}}

    def bounds(i: int) -> dict[str, Column]:
        return {"min": F.min(columns[i]), "max": F.max(columns[i])}

    compiled, sketched = {}, {}
    for i, kind in kinds.items():
        wanted = {"values": F.count(columns[i])}
        if i in fixed_width:
            wanted |= bounds(i)
        if kind in NUMBER_KINDS:
            number = columns[i].cast("double")
            wanted |= {"mean": F.avg(number), "stddev": F.stddev_samp(number)}
        if kind == STRING:
            wanted |= {
                shape: F.count_if(columns[i].rlike(regex.to_java(pattern)))
                for shape, pattern in SHAPES.items()
            }
        compiled[i] = wanted
        wanted = {}
        if kind not in NESTED_KINDS:
            wanted["distinct"] = F.approx_count_distinct(columns[i])
            if i not in fixed_width:
                wanted |= bounds(i)
        sketched[i] = wanted

    def rows(wanted: dict[int, dict[str, Column]], names: dict[str, str]) -> DataFrame:
        """One row per column; what a column lacks is NULL."""

        def value(i: int, name: str, cast: str) -> Column:
            found = F.col(f"{name}{i}") if name in wanted[i] else F.lit(None)
            return found.cast(cast).alias(name)

        def of(part: Sequence[int]) -> DataFrame:
            aggregates = [F.count(F.lit(1)).alias("rows")]
            aggregates += [a.alias(f"{n}{i}") for i in part for n, a in wanted[i].items()]
            structs = (
                F.struct(
                    F.lit(i).alias("position"), F.col("rows"),
                    *(value(i, name, cast) for name, cast in names.items()),
                )
                for i in part
            )
            return df.agg(*aggregates).select(F.inline(F.array(*structs)))

        ids = list(wanted)
        parts = [ids[at : at + WIDTH] for at in range(0, len(ids), WIDTH)]
        return reduce(DataFrame.unionByName, (of(part) for part in parts))

    text_bounds = {"min": "string", "max": "string"}
    counts = rows(
        compiled,
        {"values": "long", **text_bounds, "mean": "double", "stddev": "double",
         **dict.fromkeys(SHAPES, "long")},
    )
    sketches = rows(sketched, {"distinct": "long", **text_bounds}).select(
        "position", "distinct", F.col("min").alias("text_min"), F.col("max").alias("text_max")
    )
    named = F.array(
        *(F.struct(F.lit(f.name).alias("name"), F.lit(kinds[i]).alias("kind")) for i, f in fields)
    )
    about = F.get(named, F.col("position"))
    return counts.join(F.broadcast(sketches), "position").select(  # one row per column
        "position",
        about["name"].alias("column_name"),
        about["kind"].alias("kind"),
        "rows",
        F.col("values").alias("n_values"),
        (F.col("rows") - F.col("values")).alias("n_nulls"),
        F.col("distinct").alias("approx_distinct"),
        F.coalesce("min", "text_min").alias("min_value"),
        F.coalesce("max", "text_max").alias("max_value"),
        "mean",
        "stddev",
        *(F.col(shape).alias(f"n_{shape}") for shape in SHAPES),
    )
