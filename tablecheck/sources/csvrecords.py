"""Counting the records of CSV files whose quoted fields span lines, by several tasks a file.

Whether a line break ends a record depends on all quotes before it, which a task that
starts in the middle of a file has not seen. So every line is read for both cases, outside
and inside a quoted field: where it ends, and how many separators it has outside quotes.
A range of lines is then one row that says, for each state it may start in, the state it
ends in, its records, and the fields of the record it begins and ends in the middle of.
These rows are few; a file's ranges are put together in order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Options under which lines can be told apart like this.
_KNOWN_OPTIONS = {"sep", "delimiter"}
_QUOTED = '"(?:[^"]++|"")*+"'
_TO_THE_CLOSING_QUOTE = '^(?:[^"]++|"")*+"'


def can_split(options: dict) -> bool:
    """Whether the options leave quotes, line ends and encoding as they are."""
    separators = [v for k, v in options.items() if k.lower() in _KNOWN_OPTIONS]
    plain = all(len(s) == 1 and s not in '"\r\n' for s in separators)
    return plain and {k.lower() for k in options} <= _KNOWN_OPTIONS


def _line_features(value: Column, separator: str) -> dict[str, Column]:
    """For a start outside (0) and inside (1) quotes: whether the line ends inside, and
    its separators outside. A quote opens a field only at its beginning."""
    sep = re.escape(separator)

    def outside(text: Column) -> tuple[Column, Column]:
        closed = F.regexp_replace(text, f"(^|{sep}){_QUOTED}", "$1x")
        ends_inside = closed.rlike(f'(^|{sep})"')
        head = F.regexp_replace(closed, f'(?s)(^|{sep})".*$', "$1")
        return ends_inside, F.char_length(head) - F.char_length(F.translate(head, separator, ""))

    closes = value.rlike(_TO_THE_CLOSING_QUOTE)
    rest = F.regexp_replace(value, _TO_THE_CLOSING_QUOTE, "x")
    open0, separators0 = outside(value)
    open1, separators1 = outside(rest)
    return {
        "end0": open0.cast("int"),
        "end1": F.when(closes, open1.cast("int")).otherwise(1),
        "sep0": separators0,
        "sep1": F.when(closes, separators1).otherwise(0),
        "blank": value == "",
    }


def _ranges(lines: DataFrame, separator: str, width: int) -> DataFrame:
    """One row for each byte range (path, block) with what it does to either state."""
    features = _line_features(F.col("value"), separator)
    rows = lines.select("path", "block", "line", *(c.alias(n) for n, c in features.items()))
    order = Window.partitionBy("path", "block").orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A line sets the state, keeps it or turns it round. What the range has made of it is
    # what the last line that sets it says, turned as often as lines did since.
    turns = ((F.col("end0") == 1) & (F.col("end1") == 0)).cast("int")
    sets = F.when(F.col("end0") == F.col("end1"), F.struct("line", "end0", "turned"))
    rows = rows.withColumn("turned", F.sum(turns).over(upto)).withColumn("last", F.max(sets).over(upto))
    out = []
    for s in (0, 1):
        since = F.col("turned") - F.coalesce(F.col("last.turned"), F.lit(0))
        state = F.pmod(F.coalesce(F.col("last.end0"), F.lit(s)) + since, F.lit(2)).cast("int")
        rows = rows.withColumn(f"after{s}", state)
        rows = rows.withColumn(f"from{s}", F.coalesce(F.lag(f"after{s}").over(order), F.lit(s)))
        ends = (F.col(f"after{s}") == 0) & ~((F.col(f"from{s}") == 0) & F.col("blank"))
        own = F.when(F.col(f"from{s}") == 0, F.col("sep0")).otherwise(F.col("sep1"))
        rows = rows.withColumn(f"ends{s}", ends).withColumn(f"seen{s}", F.sum(own).over(upto))
        rows = rows.withColumn(f"done{s}", F.max(F.when(F.col(f"ends{s}"), F.col(f"seen{s}"))).over(before))
        seen, done = F.col(f"seen{s}"), F.col(f"done{s}")
        out += [
            F.count_if(f"ends{s}").alias(f"rows{s}"),
            F.max_by(f"after{s}", "line").alias(f"state{s}"),
            F.min(F.when(F.col(f"ends{s}") & done.isNull(), seen)).alias(f"first{s}"),
            F.count_if(F.col(f"ends{s}") & done.isNotNull() & (seen - done >= width)).alias(f"wide{s}"),
            (F.max(seen) - F.coalesce(F.max(F.when(F.col(f"ends{s}"), seen)), F.lit(0))).alias(f"rest{s}"),
        ]
    return rows.groupBy("path", "block").agg(*out)


def record_counts(lines: DataFrame, separator: str, width: int) -> DataFrame:
    """path, rows (without the header) and malformed_rows, those with more than `width`
    fields, of every file with a line.

    `lines` has path, block (the byte a range starts at), line (rising within a range) and
    value. Blank lines outside quotes are no records; a quote that is never closed ends
    with the file.
    """
    ranges = _ranges(lines, separator, width)
    names = [c for c in ranges.columns if c not in ("path", "block")]
    parts = F.sort_array(F.collect_list(F.struct("block", *names)))
    start = F.struct(
        F.lit(0).alias("state"), F.lit(0).cast("long").alias("carried"),
        F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("wide"),
    )

    def add(so_far: Column, part: Column) -> Column:
        def of(name: str) -> Column:
            return F.when(so_far["state"] == 0, part[f"{name}0"]).otherwise(part[f"{name}1"])

        some = of("rows") > 0
        first = (some & (so_far["carried"] + of("first") >= width)).cast("long")
        carried = of("rest") + F.when(some, 0).otherwise(so_far["carried"])
        return F.struct(
            of("state").alias("state"),
            carried.cast("long").alias("carried"),
            (so_far["rows"] + of("rows")).alias("rows"),
            (so_far["wide"] + of("wide") + F.coalesce(first, F.lit(0))).alias("wide"),
        )

    def finish(end: Column) -> Column:
        unclosed = (end["state"] == 1).cast("long")
        wide = (unclosed == 1) & (end["carried"] >= width)
        return F.struct(
            F.greatest(end["rows"] + unclosed - 1, F.lit(0)).alias("rows"),
            (end["wide"] + wide.cast("long")).alias("malformed_rows"),
        )

    found = ranges.groupBy("path").agg(parts.alias("parts"))
    return found.select("path", F.aggregate("parts", start, add, finish).alias("x")).select("path", "x.*")
