"""Queries that learn what a table's rows obey: patterns, keys, dependencies, conditions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from tablecheck.operators.conditions import conditions
from tablecheck.operators.dependencies import dependencies, minimal_keys as keys_of
from tablecheck.operators.inclusion import implied_composite_keys
from tablecheck.operators.patterns import combined, learned_patterns as patterns_of
from tablecheck.operators.quantiles import column_quantiles as quantiles_of, robust_outliers as far_from_median

from tablecheck.operators.renames import column_signatures, renamed_columns as renames_of
from tablecheck.session import written
from tablecheck.sources.tables import from_frames

from .registered import load, query

#: A changed value in one of so many rows stands for what a bad load leaves.
SPOILED = 97

PATTERN_COLUMNS = (
    ("part", "p_name", "p_partkey"),
    ("customer", "c_name", "c_custkey"),
    ("supplier", "s_name", "s_suppkey"),
    ("pages", "url", "page_id"),
)


def _between(low: str, high: str) -> str:
    return f"CASE WHEN {low} = {high} THEN '{{' || {low} || '}}' ELSE '{{' || {low} || ',' || {high} || '}}' END"


def _patterns_sql() -> str:
    first, second = "length(split_part(p_name, ' ', 1))", "length(split_part(p_name, ' ', 2))"
    words = " || ' ' || ".join(f"'[a-z]' || {_between(f'min({w})', f'max({w})')}" for w in (first, second))
    expected = {
        "p_name": f"'^' || {words} || '$'",
        "c_name": "'^Customer#[0-9]{9}$'",
        "s_name": "'^Supplier#[0-9]{9}$'",
        "url": "CAST(NULL AS VARCHAR)",
    }
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, {expected[column]} AS pattern,"
        f" count(*) AS n_values, count(*) FILTER ({key} % {SPOILED} = 0) AS n_failing FROM {table}"
        for table, column, key in PATTERN_COLUMNS
    )


@query(_patterns_sql())
def learned_patterns(spark, sf_dir) -> DataFrame:
    """Patterns learnt from each column, and how many rows of the same table fail them once
    one value in 97 is spoiled. The many patterns of `url` are not listed."""
    parts = []
    for table, column, key in PATTERN_COLUMNS:
        df = load(spark, sf_dir, table)
        found = [r.pattern for r in patterns_of(df, [column]).collect()]
        pattern = combined(found)
        spoiled = F.when(F.col(key) % SPOILED == 0, F.concat(F.lit("?"), column)).otherwise(F.col(column))
        parts.append(
            df.select(spoiled.alias("value")).agg(
                F.lit(table).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.lit(pattern if len(found) == 1 else None).cast("string").alias("pattern"),
                F.count("value").alias("n_values"),
                F.count_if(~F.col("value").rlike(pattern)).alias("n_failing"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


KEY_TABLES = {
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


def _keys_sql() -> str:
    """Every set of up to three columns, and of those that are keys the smallest."""

    def of(table: str, columns: tuple[str, ...]) -> str:
        names = ", ".join(columns)
        listed = ",".join(columns)
        return (
            f"SELECT '{table}' AS table_name, '{listed}' AS key_columns, {len(columns)} AS size"
            f" FROM (SELECT count(*) AS parts FROM (SELECT DISTINCT {names} FROM {table})),"
            f" (SELECT count(*) AS n FROM {table}) WHERE parts = n"
        )

    every = [
        of(table, own)
        for table, columns in KEY_TABLES.items()
        for size in (1, 2, 3)
        for own in combinations(columns, size)
    ]
    return f"""WITH found AS ({" UNION ALL ".join(every)})
        SELECT * FROM found f WHERE NOT EXISTS (
            SELECT 1 FROM found g WHERE g.table_name = f.table_name AND g.size < f.size
            AND list_has_all(string_split(f.key_columns, ','), string_split(g.key_columns, ',')))"""


@query(_keys_sql())
def minimal_keys(spark, sf_dir) -> DataFrame:
    """The smallest sets of up to three columns that identify a row."""
    parts = [
        keys_of(load(spark, sf_dir, table)).select(
            F.lit(table).alias("table_name"), F.array_join("key_columns", ",").alias("key_columns"), "size"
        )
        for table in KEY_TABLES
    ]
    return reduce(DataFrame.unionByName, parts)


JOINED = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_brand", "s_name", "s_nationkey")
#: Of lines with this remainder the brand is spoiled.
SPOILED_BRAND = "l_orderkey % 700 = 3"


def _dependencies_sql(allowed: float) -> str:
    columns = ", ".join(c for c in JOINED if c != "p_brand")

    def of(own: tuple[str, ...], c: str) -> str:
        names = ", ".join(own)
        return (
            f"SELECT '{','.join(own)}' AS determinant, '{c}' AS dependent, {len(own)} AS size,"
            f" CAST(coalesce(sum(n), 0) AS BIGINT) AS violating_rows FROM"
            f" (SELECT count(*) AS n FROM joined GROUP BY {names} HAVING count(DISTINCT {c}) > 1)"
        )

    sets = [own for size in (1, 2) for own in combinations(JOINED, size)]
    every = [of(own, c) for own in sets for c in JOINED if c not in own]
    keys = [
        f"SELECT '{','.join(own)}' AS columns FROM (SELECT 1 FROM joined GROUP BY {', '.join(own)}"
        f" HAVING count(*) > 1) HAVING count(*) = 0"
        for own in sets
    ]
    has_all = "list_has_all(string_split(f.determinant, ','), string_split({}, ','))"
    return f"""WITH joined AS (
            SELECT {columns}, CASE WHEN {SPOILED_BRAND} THEN 'Brand#?' ELSE p_brand END AS p_brand
            FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        ), tried AS ({" UNION ALL ".join(every)}),
        keys AS ({" UNION ALL ".join(keys)}),
        found AS (SELECT * FROM tried WHERE violating_rows <= {allowed} * (SELECT count(*) FROM joined))
        SELECT determinant, dependent, violating_rows FROM found f
        WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE {has_all.format("k.columns")})
        AND NOT EXISTS (SELECT 1 FROM found g WHERE g.dependent = f.dependent AND g.size < f.size
                        AND {has_all.format("g.determinant")})"""


def _joined(spark, sf_dir) -> DataFrame:
    line, part, supplier = (load(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    both = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    brand = F.when(F.expr(SPOILED_BRAND), "Brand#?").otherwise(F.col("p_brand"))
    return both.withColumn("p_brand", brand).select(*JOINED)


def _found(spark, sf_dir, error: float) -> DataFrame:
    return dependencies(written(_joined(spark, sf_dir), "joined"), error=error).select(
        F.array_join("determinant", ",").alias("determinant"), "dependent", "violating_rows"
    )


@query(_dependencies_sql(0))
def column_dependencies(spark, sf_dir) -> DataFrame:
    """Sets of up to two columns of lines joined with parts and suppliers that determine
    another column in every row."""
    return _found(spark, sf_dir, 0.0)


@query(_dependencies_sql(0.25))
def column_dependencies_with_errors(spark, sf_dir) -> DataFrame:
    """The same where up to a quarter of the rows may be in groups that violate it: the
    planted wrong brands show as violating rows of p_brand."""
    return _found(spark, sf_dir, 0.25)


#: Lines joined with their orders, some shipped before the order and some with a negative
#: quantity.
LINES = """
    SELECT CASE WHEN l_orderkey % 300 = 11 THEN -l_quantity ELSE l_quantity END AS quantity,
           l_extendedprice AS price, l_discount AS discount, l_tax AS tax, o_totalprice AS total,
           CASE WHEN l_orderkey % 500 = 7 THEN o_orderdate - INTERVAL '3' DAY ELSE l_shipdate END AS shipped,
           o_orderdate AS ordered
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
#: A condition may be violated by so many rows.
CONDITION_ERROR = 0.02


def _conditions_sql() -> str:
    numbers = ("quantity", "price", "discount", "tax", "total")
    items = [(c, "0", c) for c in numbers]
    items += [(a, b, f"{a},{b}") for a, b in [*combinations(numbers, 2), ("shipped", "ordered")]]
    counted = " UNION ALL ".join(
        f"SELECT '{columns}' AS columns, '`{a}`' AS a, '{b if b == '0' else f'`{b}`'}' AS b,"
        f" count(*) FILTER ({a} < {b}) AS lt, count(*) FILTER ({a} = {b}) AS eq,"
        f" count(*) FILTER ({a} > {b}) AS gt FROM lines"
        for a, b, columns in items
    )
    tried = " UNION ALL ".join(
        f"SELECT columns, a || ' {operator} ' || b AS condition, lt + eq + gt AS rows_checked,"
        f" {bad} AS violating_rows, {rank} AS rank FROM counted"
        for rank, (operator, bad) in enumerate(
            [("=", "lt + gt"), ("<", "eq + gt"), (">", "lt + eq"), ("<=", "gt"), (">=", "lt"), ("<>", "eq")]
        )
    )
    return f"""WITH lines AS ({LINES}), counted AS ({counted}), tried AS ({tried}),
        fits AS (SELECT *, row_number() OVER (PARTITION BY columns ORDER BY rank) AS place FROM tried
                 WHERE violating_rows <= {CONDITION_ERROR} * rows_checked AND violating_rows < rows_checked)
        SELECT columns, condition, rows_checked, violating_rows FROM fits WHERE place = 1"""


@query(_conditions_sql())
def column_conditions(spark, sf_dir) -> DataFrame:
    """Signs and comparisons that at most 2 % of the lines violate, with how many do."""
    for table in ("lineitem", "orders"):
        load(spark, sf_dir, table).createOrReplaceTempView(f"discovery_{table}")
    text = LINES.replace("lineitem", "discovery_lineitem").replace("orders ON", "discovery_orders ON")
    return conditions(spark.sql(text), error=CONDITION_ERROR).select(
        "columns", "condition", "rows_checked", "violating_rows"
    )


QUANTILE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_partkey")
PROBABILITIES = (0.01, 0.25, 0.5, 0.75, 0.99)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS probability,"
        f" CAST(quantile_disc({c}, {p}) AS DOUBLE) AS quantile FROM lineitem"
        for c in QUANTILE_COLUMNS
        for p in PROBABILITIES
    )
)
def column_quantiles(spark, sf_dir) -> DataFrame:
    """Quantiles of four columns from one pass; at this accuracy they are exact."""
    return quantiles_of(load(spark, sf_dir, "lineitem"), QUANTILE_COLUMNS, PROBABILITIES, accuracy=2_000_000)


@query("""
    WITH m AS (SELECT quantile_disc(value, 0.5) AS middle FROM events),
    d AS (SELECT quantile_disc(abs(value - middle), 0.5) AS spread FROM events, m)
    SELECT event_id, value FROM events, m, d
    WHERE spread > 0 AND abs(value - middle) > 3.5 * (spread * 1.4826)
""")
def robust_outliers(spark, sf_dir) -> DataFrame:
    """Events whose value is far from the median, by the median distance from it."""
    found = far_from_median(load(spark, sf_dir, "events"), ["value"], accuracy=2_000_000)
    return found.select("event_id", "value")


#: The parts and suppliers of lines that were not returned, as a table of its own: what
#: returned lines refer to is not always in it.
SUPPLIES = """
    SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem
    WHERE l_returnflag <> 'R'
"""


def _composite_sql() -> str:
    def of(child: tuple[str, str], parent: tuple[str, str]) -> str:
        c, p = ", ".join(child), ", ".join(parent)
        return (
            f"SELECT 'lineitem' AS child_table, '{','.join(child)}' AS child_column,"
            f" 'partsupp' AS parent_table, '{','.join(parent)}' AS parent_column,"
            f" (SELECT count(*) FROM (SELECT DISTINCT {c} FROM lineitem)) AS distinct_values,"
            f" (SELECT count(*) FROM (SELECT {c} FROM lineitem INTERSECT SELECT {p} FROM partsupp)) AS matched,"
            f" (SELECT count(*) FROM partsupp) = (SELECT count(*) FROM (SELECT DISTINCT {p} FROM partsupp))"
            f" AS parent_is_unique"
        )

    both = ("l_partkey", "l_suppkey")
    every = f"{of(both, ('ps_partkey', 'ps_suppkey'))} UNION ALL {of(both, ('ps_suppkey', 'ps_partkey'))}"
    return f"""WITH partsupp AS ({SUPPLIES}), found AS ({every})
        SELECT *, CAST(matched AS DOUBLE) / distinct_values AS coverage FROM found WHERE matched > 0"""


@query(_composite_sql())
def implied_composite_fk(spark, sf_dir) -> DataFrame:
    """Which two columns of the lines are found together in the table of supplies."""
    lines = load(spark, sf_dir, "lineitem")
    supplies = lines.where("l_returnflag <> 'R'").selectExpr(
        "l_partkey AS ps_partkey", "l_suppkey AS ps_suppkey"
    ).distinct()
    return implied_composite_keys(
        from_frames({"lineitem": lines, "partsupp": supplies}),
        [("lineitem", "l_partkey"), ("lineitem", "l_suppkey")],
        [("partsupp", "ps_partkey"), ("partsupp", "ps_suppkey")],
    )


@query("""
    SELECT * FROM (VALUES ('c_name', 'customer_name', 1.0), ('c_acctbal', 'balance', 1.0),
                          ('c_mktsegment', 'segment', 1.0)) AS t(old_name, new_name, similarity)
    WHERE (SELECT count(DISTINCT c_name) FROM customer) > 0
""".replace("1.0)", "CAST(1.0 AS DOUBLE))"))
def renamed_columns(spark, sf_dir) -> DataFrame:
    """Three columns of the customers under new names, one of them with another type, next
    to one that is gone and one that is new."""
    customer = load(spark, sf_dir, "customer")
    after = customer.select(
        "c_custkey",
        F.upper("c_name").alias("shout"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast("decimal(20, 6)").alias("balance"),
        F.col("c_name").alias("customer_name"),
    )
    return renames_of(column_signatures(customer), column_signatures(after))
