"""Patterns a text column's values follow, learnt from the values.

A value is a sequence of tokens. Read more and more coarsely it has a signature on each
of five levels, from runs of upper-case letters, lower-case letters and digits to "any
text", and a signature determines the coarser ones: signatures form a tree. What is kept
of a group of values with one signature, how many they are and for every token the range
of its lengths and whether it is always the same, merges with that of another group, so
all groups of all columns and levels are one aggregate.

A group's description length is the bits of its pattern and of its values told with the
pattern's help. A group is told as one if that is shorter than telling the groups below
it one by one; the groups that are left are the column's patterns.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import regex
from ..functions.sqltext import quote_column, string_literal
from ..functions.typing import STRING, field_type, kind_of
from ..session import written

#: What a token may consist of, narrow before wide, and the bits of one of
#: its characters. A token that fits none is any text.
_CLASSES = (
    ("[0-9]", 3.3),
    ("[a-z]", 4.7),
    ("[A-Z]", 4.7),
    (r"[^\x00-@\[-\x60{-\x7F]", 5.7),
    (r"[^\x00-/:-@\[-\x60{-\x7F]", 6.0),
)
#: Of a list of words the separator stands once.
_LIST, _ANY = 3, 4
_ANY_TEXT, _ANY_BITS = r"[\s\S]", 7.0
#: Bits of a pattern, of a token's class with its lengths, and of a
#: character of a literal.
_PATTERN_BITS, _TOKEN_BITS, _CHARACTER_BITS = 16.0, 16.0, 8.0
#: A value with more characters is any text.
LONGEST = 256
_LONG = "\x01"
#: Fixed value: the highest repetition RE2 takes.
_MOST = 1000


def _signatures(value: Column) -> list[Column]:
    """The signature on each level. Long values have one of their own below the last."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    plain = F.regexp_replace(value, r"[^\x00-\x7F]+", "é")
    classed = F.translate(plain, upper + lower + digits, "A" * 26 + "a" * 26 + "0" * 10)
    runs = reduce(lambda c, run: F.regexp_replace(c, f"{run}+", run), "Aa0", classed)
    words = F.regexp_replace(runs, "[Aaé]+", "a")
    alphanumeric = F.regexp_replace(words, "[a0]+", "a")
    listed = F.regexp_replace(alphanumeric, r"^a([^a])a(?:\1a)*$", "a$1+")
    long = F.char_length(value) > LONGEST
    levels = [runs, words, alphanumeric, listed]
    return [*(F.when(long, _LONG).otherwise(level) for level in levels), F.lit("")]


def _tokens(value: Column, level: int) -> Column:
    """The tokens of a value; their number and order follow from its signature."""
    if level == _ANY:
        return F.array(value)
    alphanumeric = r"[A-Za-z0-9[^\x00-\x7F]]+"
    runs = {
        0: r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7F]+|[\x00-\x7F]",
        1: r"[A-Za-z[^\x00-\x7F]]+|[0-9]+|[\x00-\x7F]",
    }.get(level, rf"{alphanumeric}|[\x00-\x7F]")
    found = F.regexp_extract_all(value, F.lit(f"(?s){runs}"), F.lit(0))
    whole = (F.char_length(value) > LONGEST) | (value == "")
    return F.when(whole, F.array(value)).otherwise(found)


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value and hash of all values that are not NULL, from one scan."""
    cells = F.array(
        *(
            F.struct(F.lit(c).alias("column_name"), F.col(quote_column(c, df.schema)).alias("value"))
            for c in columns
        )
    )
    found = df.select(F.inline(cells)).where("value IS NOT NULL")
    return found.withColumn("hash", F.xxhash64("value"))


def _readings(cells: DataFrame) -> DataFrame:
    """Each value on each level: level, signature, parent (the next level's) and tokens."""
    levels = F.array(*_signatures(F.col("value")))
    each = F.array(
        *(
            F.struct(
                F.lit(k).alias("level"),
                F.get("levels", F.lit(k)).alias("signature"),
                F.get("levels", F.lit(min(k + 1, _ANY))).alias("parent"),
                _tokens(F.col("value"), k).alias("tokens"),
            )
            for k in range(_ANY + 1)
        )
    )
    return cells.withColumn("levels", levels).select(
        "column_name", "hash", "value", F.inline(each)
    )


def _place(level: Column, signature: Column, at: Column) -> Column:
    """The place of a token in its pattern: all words of a list share the first, all its
    separators the second."""
    return F.when((level == _LIST) & signature.endswith("+"), at % 2).otherwise(at)


def _elements(readings: DataFrame) -> DataFrame:
    """For each group and place: how many tokens, of what lengths, and whether always the
    same; the buffers are numbers, so the aggregate is compiled."""
    token = F.col("token")
    return (
        readings.select(
            "column_name", "level", "signature", "parent", "hash", F.posexplode("tokens").alias("at", "token")
        )
        .groupBy(
            "column_name", "level", "signature", "parent",
            _place(F.col("level"), F.col("signature"), F.col("at")).alias("place"),
        )
        .agg(
            F.count("*").alias("tokens"),
            F.min("at").alias("first"),
            F.count_if(F.col("at") == 0).alias("starts"),
            F.min(F.char_length(token)).alias("shortest"),
            F.max(F.char_length(token)).alias("longest"),
            F.sum(F.char_length(token)).alias("characters"),
            (F.min(F.xxhash64(token)) == F.max(F.xxhash64(token))).alias("literal"),
            F.min("hash").alias("example"),
            F.max("at").alias("last"),
            *(
                F.count_if(token.rlike(regex.to_java(f"^{c}+$"))).alias(f"class{k}")
                for k, (c, _) in enumerate(_CLASSES)
            ),
        )
    )


def _by_class(value: int) -> Column:
    """The text (0) or the bits (1) of the narrowest class that all tokens fit."""
    out = F.lit((_ANY_TEXT, _ANY_BITS)[value])
    for k, of in reversed(list(enumerate(_CLASSES))):
        out = F.when(F.col(f"class{k}") == F.col("tokens"), F.lit(of[value])).otherwise(out)
    return out


def _groups(elements: DataFrame) -> DataFrame:
    """column_name, level, signature, parent, n, bits and example of every group."""
    told = F.col("characters") * _by_class(1) + F.col("tokens") * F.log2(
        (F.col("longest") - F.col("shortest") + 1).cast("double")
    )
    literal = F.col("longest") * _CHARACTER_BITS
    bits = F.when(F.col("literal"), literal).otherwise(told + _TOKEN_BITS)
    groups = (
        elements.withColumn("bits", bits)
        .groupBy("column_name", "level", "signature", "parent")
        .agg(
            F.max("starts").alias("n"),
            F.sum("bits").alias("bits"),
            F.min("example").alias("example"),
            F.max(F.when(F.col("signature").endswith("+") & (F.col("level") == _LIST), F.col("last"))).alias("last"),
        )
    )
    totals = groups.where(F.col("level") == _ANY).select("column_name", F.col("n").alias("all"))
    # which pattern a value follows, and the number of words of a list, are told as well
    chosen = F.col("n") * F.log2(F.col("all") / F.col("n"))
    counted = F.when(F.col("last") > 2, F.col("n") * F.log2(F.col("last") / 2.0)).otherwise(0.0)
    return groups.join(totals, "column_name").select(
        "column_name", "level", "signature", "parent", "n", "example",
        (F.col("bits") + chosen + counted + _PATTERN_BITS).alias("bits"),
    )


def _shortest(groups: DataFrame) -> DataFrame:
    """The groups that together tell all values in the fewest bits."""
    key = ["column_name", "signature"]
    levels = [groups.where(F.col("level") == k) for k in range(_ANY + 1)]
    known = levels[0].withColumn("best", F.col("bits")).withColumn("whole", F.lit(True))
    scored = [known]
    for level in levels[1:]:
        below = known.groupBy("column_name", F.col("parent").alias("signature")).agg(
            F.sum("best").alias("below")
        )
        known = level.join(below, key).withColumn("whole", F.col("bits") <= F.col("below"))
        known = known.withColumn("best", F.least("bits", "below")).drop("below")
        scored.append(known)
    open_groups = scored[_ANY]
    chosen = []
    for k in range(_ANY, -1, -1):
        chosen.append(open_groups.where("whole").select("column_name", "level", "signature", "n", "bits"))
        if k:
            split = open_groups.where(~F.col("whole")).select(
                "column_name", F.col("signature").alias("parent")
            )
            open_groups = scored[k - 1].join(split, ["column_name", "parent"], "left_semi")
    return reduce(DataFrame.unionByName, chosen)


def _piece(text: Column) -> Column:
    """A token as regular expression text."""
    escaped = F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$])", r"\\$1")
    low, high = F.col("shortest"), F.col("longest")
    times = (
        F.when(high > _MOST, "*")
        .when((low == high) & (low == 1), "")
        .when(low == high, F.concat(F.lit("{"), low.cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit("{"), low.cast("string"), F.lit(","), high.cast("string"), F.lit("}")))
    )
    return F.when(F.col("literal"), escaped).otherwise(F.concat(_by_class(0), times))


def _listed(pieces: Column, last: Column) -> Column:
    """A list's words and separator as one expression: `word(?:separator word){m,n}`."""
    rest = F.concat(F.lit("(?:"), F.get(pieces, F.lit(1)), F.get(pieces, F.lit(0)), F.lit(")+"))
    return F.concat(F.get(pieces, F.lit(0)), rest)


def learned_patterns(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """column_name, pattern (for RE2, the whole value), n_values and bits: every value of
    each text column matches a pattern of its column.

    NULLs are left out; a column without values has no rows. `columns` defaults to all
    text columns. Lengths are those met, so a pattern is as narrow as its values. What
    comes back is as long as there are patterns, which for free text is one.
    """
    names = list(columns or (f.name for f in df.schema.fields if kind_of(f.dataType) == STRING))
    for name in names:
        if kind_of(field_type(df.schema, name)) != STRING:
            raise ValueError(f"column {name!r} is not text")
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, pattern string, n_values long, bits double")
    cells = _cells(df, names)
    elements = written(_elements(_readings(cells)), "elements")
    chosen = written(_shortest(written(_groups(elements), "groups")), "patterns")
    own = ["column_name", "level", "signature"]
    parts = elements.join(chosen.select(*own), own, "left_semi")
    # The text of a literal is read off one value of its group, found by its hash.
    wanted = parts.where("literal").select(*own, F.col("example").alias("hash")).distinct()
    # Only the values with such a hash are read once more.
    few = written(wanted, "examples")
    examples = cells.join(few.select("column_name", "hash").distinct(), ["column_name", "hash"], "left_semi")
    readings = _readings(examples.dropDuplicates(["column_name", "hash", "value"]))
    texts = readings.join(few, [*own, "hash"], "left_semi").dropDuplicates([*own, "hash"])
    texts = texts.select(*own, F.col("hash").alias("example"), F.col("tokens").alias("words"))
    told = (
        parts.join(texts, [*own, "example"], "left")
        .withColumn("piece", _piece(F.get("words", F.col("first"))))
        .groupBy(*own)
        .agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"), F.max("last").alias("last"))
    )
    pieces = F.transform("pieces", lambda p: p["piece"])
    is_list = (F.col("level") == _LIST) & F.col("signature").endswith("+")
    whole = F.when(is_list, _listed(pieces, F.col("last"))).otherwise(F.array_join(pieces, ""))
    return told.join(chosen, own).select(
        "column_name",
        F.concat(F.lit("^"), whole, F.lit("$")).alias("pattern"),
        F.col("n").alias("n_values"),
        "bits",
    )


def combined(patterns: Iterable[str]) -> str:
    """One pattern for values that follow any of the patterns."""
    patterns = sorted(patterns)
    if len(patterns) == 1:
        return patterns[0]
    return "^(?:" + "|".join(p[1:-1] for p in patterns) + ")$"


def violates(column: str, pattern: str) -> str:
    """The predicate of the rows that do not follow the pattern, as Spark SQL text."""
    return f"NOT {column} RLIKE {string_literal(regex.to_java(pattern))}"


def accepted(patterns: Iterable[tuple[str, int]], min_share: float = 0.99, most: int = 10) -> str | None:
    """One pattern from the (pattern, n_values) of a column: the most frequent ones until
    they cover `min_share` of the values. None if that takes more than `most` or is no
    restriction."""
    ranked = sorted(patterns, key=lambda p: (-p[1], p[0]))
    total, covered, taken = sum(n for _, n in ranked), 0, []
    for pattern, n in ranked:
        if covered >= min_share * total:
            break
        taken.append(pattern)
        covered += n
    if not taken or len(taken) > most or any(p.startswith("^" + _ANY_TEXT) for p in taken):
        return None
    return combined(taken)
