"""Quantiles of many columns from one pass, and bounds that a few wild values do not move.

The sketch behind `percentile_approx` merges, and a quantile it gives has a rank off by at
most rows / accuracy. Its size is the accuracy, and one task merges all of them. So beyond
`SKETCHED` a small sketch only says between which values a quantile lies, and those, a few
in ten thousand rows, are counted: the rank is exact then.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.predicates import require_numbers
from ..functions.sqltext import quote_column
from ..functions.typing import NUMBER_KINDS, kind_of
from ..session import local_frame
from .outliers import chosen_columns

ACCURACY = 10_000
#: The greatest accuracy that is left to a sketch.
SKETCHED = 50_000
#: How far around a quantile values are counted, in rank errors of the small sketch.
MARGIN = 3.0
#: Of a normal distribution the median distance from the median is the
#: deviation divided by this; values this many deviations away are outliers.
MAD_SCALE, MAD_LIMIT = 1.4826, 3.5
#: Fixed value: a far value is this many quartile distances outside the quartiles.
FENCE = 3.0


def _value(df: DataFrame, name: str) -> Column:
    """The column as double; NaN is no value."""
    return F.nanvl(F.col(quote_column(name, df.schema)).cast("double"), F.lit(None))


def _exact(df: DataFrame, values: Sequence[Column], probabilities: Sequence[float]) -> list[list[float | None]]:
    """For each of the values its quantiles of exact rank, as numbers.

    A sketch brackets each quantile. The rows below a bracket are counted and those inside
    grouped by value; a bracket that misses the rank is widened, at last to all values.
    """
    rows = df.select(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    counts = rows.agg(*(F.count(c) for c in rows.columns)).first()
    out: list[list[float | None]] = [[None] * len(probabilities) for _ in values]
    ranks = {
        (i, k): min(max(math.ceil(p * n), 1), n)
        for i, n in enumerate(counts) if n
        for k, p in enumerate(probabilities)
    }
    margin = MARGIN / ACCURACY
    while ranks:
        ends = sorted(ranks)
        asked = {i: sorted({j for j in ends if j[0] == i}) for i, _ in ends}
        around = {i: [x for _, k in own for x in (probabilities[k] - margin, probabilities[k] + margin)] for i, own in asked.items()}
        sketched = rows.agg(
            *(
                F.percentile_approx(f"v{i}", [min(max(x, 0.0), 1.0) for x in around[i]], ACCURACY).alias(f"q{i}")
                for i in asked
            )
        ).first()
        # A bracket that begins or ends with the probabilities has no bound there.
        brackets = {}
        for i, own in asked.items():
            for at, j in enumerate(own):
                low, high = around[i][2 * at : 2 * at + 2]
                brackets[j] = (
                    sketched[f"q{i}"][2 * at] if low > 0 else -math.inf,
                    sketched[f"q{i}"][2 * at + 1] if high < 1 else math.inf,
                )
        below = rows.agg(*(F.count_if(F.col(f"v{j[0]}") < F.lit(brackets[j][0])) for j in ends)).first()
        inside = F.array(
            *(
                F.when(
                    F.col(f"v{i}").between(F.lit(brackets[i, k][0]), F.lit(brackets[i, k][1])),
                    F.struct(F.lit(at).alias("at"), F.col(f"v{i}").alias("value")),
                )
                for at, (i, k) in enumerate(ends)
            )
        )
        grouped = (
            rows.select(F.inline(F.array_compact(inside)))
            .groupBy("at", "value").agg(F.count("*").alias("n"))
        )
        upto = F.sum("n").over(Window.partitionBy("at").orderBy("value"))
        wanted = F.get(F.array(*(F.lit(ranks[j] - b).cast("long") for j, b in zip(ends, below))), F.col("at"))
        found = (
            grouped.withColumn("upto", upto).withColumn("wanted", wanted)
            .where("wanted > upto - n AND wanted <= upto").collect()  # one row for each quantile
        )
        for r in found:
            i, k = ends[r["at"]]
            out[i][k] = r["value"]
            del ranks[i, k]
        margin *= 8
    return out


def column_quantiles(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    probabilities: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """column_name, probability and quantile for number columns, from one scan. A quantile
    is a value of the column whose rank is off by at most rows / accuracy; NULL and NaN
    are left out, and a column without values has NULL quantiles. With an accuracy above
    `SKETCHED` ranks are exact, and found by jobs of their own."""
    names = list(columns or (f.name for f in df.schema.fields if kind_of(f.dataType) in NUMBER_KINDS))
    require_numbers(df.schema, names)
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, probability double, quantile double")
    if accuracy > SKETCHED:
        found = _exact(df, [_value(df, c) for c in names], list(probabilities))
        rows = [(c, float(p), q) for c, own in zip(names, found) for p, q in zip(probabilities, own)]
        return local_frame(df.sparkSession, rows, "column_name string, probability double, quantile double")
    sketches = df.agg(
        *(
            F.percentile_approx(_value(df, c), list(probabilities), accuracy).alias(f"q{i}")
            for i, c in enumerate(names)
        )
    )
    cells = F.array(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(float(p)).alias("probability"),
                F.get(f"q{i}", F.lit(k)).alias("quantile"),
            )
            for i, c in enumerate(names)
            for k, p in enumerate(probabilities)
        )
    )
    return sketches.select(F.inline(cells))


def robust_outliers(
    df: DataFrame, columns: Sequence[str], which: str = "first", accuracy: int = ACCURACY
) -> DataFrame:
    """Rows with a value more than `MAD_LIMIT` robust deviations from its column's median.

    The deviation is the median distance from the median, so outliers do not widen it. If
    it is 0, more than half of the values are the same and no other is an outlier. Both
    medians reach the filter as scalar subqueries: no join and no collect. With an accuracy
    above `SKETCHED` they are found first, exactly, and reach it as numbers.
    """
    columns = chosen_columns(columns, which)
    require_numbers(df.schema, columns)
    values = [_value(df, c) for c in columns]
    if accuracy > SKETCHED:
        middles = [q[0] for q in _exact(df, values, [0.5])]
        distances = [F.abs(v - F.lit(m).cast("double")) for v, m in zip(values, middles)]
        halves = [F.lit(q[0]).cast("double") for q in _exact(df, distances, [0.5])]
        return df.where(_far(distances, halves))
    medians = df.agg(
        F.struct(*(F.percentile_approx(v, 0.5, accuracy).alias(f"m{i}") for i, v in enumerate(values))).alias("m")
    ).scalar()
    distances = [F.abs(v - medians[f"m{i}"]) for i, v in enumerate(values)]
    spreads = df.agg(
        F.struct(*(F.percentile_approx(d, 0.5, accuracy).alias(f"d{i}") for i, d in enumerate(distances))).alias("d")
    ).scalar()
    return df.where(_far(distances, [spreads[f"d{i}"] for i in range(len(values))]))


def _far(distances: Sequence[Column], halves: Sequence[Column]) -> Column:
    """Whether a distance is too far, `halves` being the median distances."""
    condition = F.lit(False)
    for distance, half in zip(distances, halves):
        spread = half * MAD_SCALE
        condition = condition | ((spread > 0) & (distance > MAD_LIMIT * spread))
    return condition


def robust_ranges(df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY) -> dict[str, tuple]:
    """For each of the table's own columns the bounds that only far values are outside of: its smallest and
    greatest value, or the fence where a value is beyond it."""
    if not columns:
        return {}
    quartiles: dict[str, dict[float, float]] = {}
    for r in column_quantiles(df, columns, (0.25, 0.75), accuracy).collect():
        quartiles.setdefault(r.column_name, {})[r.probability] = r.quantile
    ends = df.agg(
        *(f(_value(df, c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("z", F.max)))
    ).first()
    out = {}
    for i, c in enumerate(columns):
        low, high = quartiles[c][0.25], quartiles[c][0.75]
        if low is None:
            continue
        reach = FENCE * (high - low)
        small, great = ends[f"a{i}"], ends[f"z{i}"]
        if reach > 0:
            small, great = max(small, low - reach), min(great, high + reach)
        out[c] = (small, great)
    return out
