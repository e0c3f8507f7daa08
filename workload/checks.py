"""The predefined checks, each on tables where it finds something."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck.functions import predicates as P
from tablecheck.operators.conformance import type_conformance
from tablecheck.operators.duplicates import full_row_duplicates, no_duplicates_pk as duplicates
from tablecheck.operators.inclusion import implied_foreign_keys
from tablecheck.operators.outliers import outlier_detection as outliers
from tablecheck.operators.profile import column_profile as profile
from tablecheck.operators.referential import orphan_values, referential_integrity as orphans
from tablecheck.operators import rowchecks, rowcount
from tablecheck.plans.suggestions import suggest_checks
from tablecheck.session import shared_dir
from tablecheck.sources import tables as T

from .registered import load, query


@query("""
    WITH c AS (
        SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS source_rows,
               (SELECT count(*) FROM orders) AS target_rows
    )
    SELECT source_rows, target_rows, abs(source_rows - target_rows) AS rows_affected,
           CASE WHEN source_rows = target_rows THEN 'PASS' ELSE 'FAIL' END AS status
    FROM c
""")
def row_count_match(spark, sf_dir):
    source = load(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return rowcount.row_count_match(source, load(spark, sf_dir, "orders"))


@query("""
    SELECT d.doc_id, lang, source, quality, toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    WHERE quality IS NULL OR toxic IS NULL
""")
def no_nulls_required(spark, sf_dir):
    labelled = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rowchecks.no_nulls_required(
        labelled.select("doc_id", "lang", "source", "quality", "toxic"), ["quality", "toxic"]
    )


@query("""
    SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def no_duplicates_pk(spark, sf_dir):
    return duplicates(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    SELECT conv_id, role, count(*) AS duplicate_count FROM conversations
    GROUP BY conv_id, role HAVING count(*) > 1
""")
def no_duplicates_pk_role(spark, sf_dir):
    return duplicates(load(spark, sf_dir, "conversations"), ["conv_id", "role"])


#: The given keys all have parents. Orphans are planted in the children by this rule: where
#: the condition holds a key becomes one below 0, which no parent has.
ORPHANS = {
    "user_id": "value > 50", "l_partkey": "l_linenumber = 7", "l_suppkey": "l_quantity = 50",
}


def planted(column: str) -> str:
    return f"CASE WHEN {ORPHANS[column]} THEN -1 - {column} ELSE {column} END"


def with_orphans(children, *columns: str):
    return children.withColumns({c: F.expr(planted(c)) for c in columns})


@query(f"""
    WITH e AS (SELECT {planted("user_id")} AS user_id FROM events)
    SELECT 'user_id' AS fk_column, CAST(user_id AS VARCHAR) AS invalid_value,
           count(*) AS occurrence_count
    FROM e
    WHERE user_id IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id)
    GROUP BY user_id
""")
def referential_integrity_events(spark, sf_dir):
    events = with_orphans(load(spark, sf_dir, "events"), "user_id")
    return orphan_values(events, "user_id", load(spark, sf_dir, "customer"), "c_custkey")


@query(f"""
    WITH line AS (SELECT {planted("l_partkey")} AS l_partkey,
                         {planted("l_suppkey")} AS l_suppkey FROM lineitem)
    SELECT 'l_partkey' AS fk_column, CAST(l_partkey AS VARCHAR) AS invalid_value,
           count(*) AS occurrence_count
    FROM line WHERE l_partkey IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM part WHERE p_partkey = l_partkey)
    GROUP BY l_partkey
    UNION ALL
    SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), count(*)
    FROM line WHERE l_suppkey IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)
    GROUP BY l_suppkey
""")
def referential_integrity(spark, sf_dir):
    tables = T.from_frames(
        {
            "shop.parts": load(spark, sf_dir, "part"),
            "shop.suppliers": load(spark, sf_dir, "supplier"),
        }
    )
    checks = {
        "l_partkey": {"table": "proj.shop.parts", "column": "p_partkey"},
        "l_suppkey": {"table": "shop.suppliers", "column": "s_suppkey"},
    }
    lineitem = with_orphans(load(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return orphans(lineitem, checks, tables)


@query("""
    SELECT 'l_orderkey' AS fk_column, CAST(l_orderkey AS VARCHAR) AS invalid_value,
           count(*) AS occurrence_count
    FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM orders
        WHERE o_orderkey = l_orderkey AND o_orderdate >= TIMESTAMP '1996-01-01')
    GROUP BY l_orderkey
""")
def referential_integrity_late(spark, sf_dir):
    """Against a parent that is a part of a table: lines of orders before a day."""
    late = load(spark, sf_dir, "orders").where("o_orderdate >= '1996-01-01'")
    return orphan_values(load(spark, sf_dir, "lineitem"), "l_orderkey", late, "o_orderkey")


@query(f"""
    WITH e AS (SELECT {planted("user_id")} AS user_id FROM events)
    SELECT 'user_id' AS fk_column, CAST(user_id AS VARCHAR) AS invalid_value,
           count(*) AS occurrence_count
    FROM e WHERE user_id IS NOT NULL AND CAST(user_id AS VARCHAR) NOT IN (
        SELECT CAST(CAST(substr(c_name, 10) AS BIGINT) AS VARCHAR) FROM customer)
    GROUP BY user_id
""")
def referential_integrity_id_as_string(spark, sf_dir):
    known = load(spark, sf_dir, "customer").select(
        F.substring("c_name", 10, 9).cast("bigint").cast("string").alias("customer_id")
    )
    events = with_orphans(load(spark, sf_dir, "events"), "user_id")
    return orphan_values(events, "user_id", known, "customer_id")


@query("SELECT * FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def numeric_range(spark, sf_dir):
    return rowchecks.numeric_range(
        load(spark, sf_dir, "customer"), {"c_acctbal": {"min": 0, "max": 9000}}
    )


@query("""
    SELECT * FROM lineitem
    WHERE l_quantity < 5 OR l_quantity > 45 OR l_discount < 0 OR l_discount > 0.09
""")
def numeric_range_multi(spark, sf_dir):
    return rowchecks.numeric_range(
        load(spark, sf_dir, "lineitem"),
        {"l_quantity": {"min": 5, "max": 45}, "l_discount": {"min": 0, "max": 0.09}},
    )


@query("""
    SELECT vec_id, label, place, entry FROM (
        SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS place, CAST(x AS DOUBLE) AS entry,
               CASE WHEN x < 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(x AS DOUBLE) END AS raw
        FROM (SELECT vec_id, label, unnest(embedding) AS x,
                     generate_subscripts(embedding, 1) AS i FROM embeddings))
    WHERE (NOT isnan(raw) AND (raw < 0 OR raw > 0.1)) OR entry < -0.2 OR entry > 0.2
""")
def numeric_range_nan(spark, sf_dir):
    """Every entry of every vector; those below 0 are NaN in one of two columns."""
    entries = load(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("place", "x")
    )
    entry = F.col("x").cast("double")
    rows = entries.select(
        "vec_id", "label", "place",
        F.when(entry < 0, float("nan")).otherwise(entry).alias("raw"), entry.alias("entry"),
    )
    return rowchecks.numeric_range(
        rows, {"raw": {"min": 0, "max": 0.1}, "entry": {"min": -0.2, "max": 0.2}}
    ).drop("raw")


@query("""
    SELECT * FROM orders
    WHERE o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2000-12-31'
""")
def date_range(spark, sf_dir):
    return rowchecks.date_range(
        load(spark, sf_dir, "orders"),
        {"o_orderdate": {"min_date": "1996-01-01", "max_date": "2000-12-31"}},
    )


@query("""
    SELECT * FROM events
    WHERE ts < TIMESTAMP '2024-01-02 00:00:00' OR ts > TIMESTAMP '2024-01-29 00:00:00'
""")
def date_range_midnight(spark, sf_dir):
    return rowchecks.date_range(
        load(spark, sf_dir, "events"), {"ts": {"min_date": "2024-01-02", "max_date": "2024-01-29"}}
    )


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https://')")
def pattern_validation(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return rowchecks.pattern_validation(pages, {"url": "^https://"})


@query("""
    SELECT * FROM part WHERE NOT regexp_matches(p_name, '^(blue|small) [a-z]+$')
        OR NOT regexp_matches(CAST(p_size AS VARCHAR), '^[1-4]?[0-9]$')
""")
def pattern_validation_multi(spark, sf_dir):
    return rowchecks.pattern_validation(
        load(spark, sf_dir, "part"),
        {"p_name": "^(blue|small) [a-z]+$", "p_size": "^[1-4]?[0-9]$"},
    )


@query(r"""
    SELECT doc_id, lang, n_chars FROM documents
    WHERE NOT regexp_matches(text, '[[:alpha:]]+[.!?]$')
""")
def pattern_validation_whole_text(spark, sf_dir):
    documents = load(spark, sf_dir, "documents")
    found = rowchecks.pattern_validation(documents, {"text": "[[:alpha:]]+[.!?]$"})
    return found.select("doc_id", "lang", "n_chars")


@query("""
    WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)
    SELECT e.* FROM events e, s WHERE abs(value - m) > 3 * sd
""")
def outlier_detection(spark, sf_dir):
    return outliers(load(spark, sf_dir, "events"), ["value"])


@query("""
    WITH s AS (SELECT avg(CAST(n_chars AS DOUBLE)) AS m, stddev_samp(n_chars) AS sd
               FROM documents)
    SELECT doc_id, lang, source, n_chars FROM documents, s WHERE abs(n_chars - m) > 3 * sd
""")
def outlier_detection_len(spark, sf_dir):
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return outliers(documents, ["n_chars", "doc_id"])


@query("""
    WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd,
                      avg(CAST(user_id AS DOUBLE)) AS um, stddev_samp(user_id) AS usd FROM events)
    SELECT e.* FROM events e, s WHERE abs(value - m) > 3 * sd OR abs(user_id - um) > 3 * usd
""")
def outlier_detection_all(spark, sf_dir):
    return outliers(load(spark, sf_dir, "events"), ["value", "user_id"], which="all")


@query("""
    SELECT quality, toxic, count(*) AS duplicate_count FROM labels
    GROUP BY quality, toxic HAVING count(*) > 1
""")
def full_row_duplicates_narrow(spark, sf_dir):
    return full_row_duplicates(load(spark, sf_dir, "labels").select("quality", "toxic"))


@query("""
    SELECT text, lang, source, n_chars, count(*) AS duplicate_count FROM documents
    GROUP BY text, lang, source, n_chars HAVING count(*) > 1
""")
def full_row_duplicates_wide(spark, sf_dir):
    return full_row_duplicates(load(spark, sf_dir, "documents").drop("doc_id"))


def _bad(table: str, column: str, expression: str, declared: str, sql_type: str) -> str:
    return f"""
        SELECT '{column}' AS column_name, '{declared}' AS declared,
               count({expression}) AS n_values,
               count(*) FILTER (WHERE {expression} IS NOT NULL
                                AND try_cast({expression} AS {sql_type}) IS NULL) AS unconvertible
        FROM {table}"""


@query(" UNION ALL ".join([
    _bad("orders", "o_orderpriority", "o_orderpriority", "bigint", "BIGINT"),
    _bad("orders", "priority_level", "substr(o_orderpriority, 1, 1)", "INT64", "BIGINT"),
    _bad("orders", "status_flag",
         "CASE WHEN o_orderstatus = 'O' THEN '1' ELSE o_orderstatus END", "double", "DOUBLE"),
]))
def type_conformance_orders(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.substring("o_orderpriority", 1, 1).alias("priority_level"),
        F.when(F.col("o_orderstatus") == "O", "1").otherwise(F.col("o_orderstatus"))
        .alias("status_flag"),
    )
    return type_conformance(
        orders, {"o_orderpriority": "bigint", "priority_level": "INT64", "status_flag": "double"}
    )


@query(_bad("documents", "text", "text", "double", "DOUBLE"))
def type_conformance_text(spark, sf_dir):
    return type_conformance(load(spark, sf_dir, "documents"), {"text": "double"})


_CHILDREN = [
    ("events", "user_id"), ("documents", "doc_id"), ("lineitem", "l_orderkey"),
    ("lineitem", "l_partkey"), ("lineitem", "l_suppkey"), ("orders", "o_custkey"),
]
_PARENTS = [
    ("customer", "c_custkey"), ("labels", "doc_id"), ("orders", "o_orderkey"),
    ("part", "p_partkey"), ("supplier", "s_suppkey"),
]


def _implied_sql() -> str:
    def values(pairs):
        return " UNION ALL ".join(
            f"SELECT '{t}' AS t, '{c}' AS c, {c} AS v, count(*) AS n FROM {t}"
            f" WHERE {c} IS NOT NULL GROUP BY {c}"
            for t, c in pairs
        )

    return f"""
        WITH child AS ({values(_CHILDREN)}), parent AS ({values(_PARENTS)}),
        sizes AS (SELECT t, c, count(*) AS distinct_values FROM child GROUP BY t, c),
        keys AS (SELECT t, c, max(n) = 1 AS is_unique FROM parent GROUP BY t, c),
        hits AS (
            SELECT child.t AS ct, child.c AS cc, parent.t AS pt, parent.c AS pc,
                   count(*) AS matched
            FROM child JOIN parent ON child.v = parent.v
                AND (child.t <> parent.t OR child.c <> parent.c)
            GROUP BY ALL
        )
        SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column,
               distinct_values, matched,
               CAST(matched AS DOUBLE) / distinct_values AS coverage,
               is_unique AS parent_is_unique
        FROM hits JOIN sizes ON ct = sizes.t AND cc = sizes.c
        JOIN keys ON pt = keys.t AND pc = keys.c
    """


@query(_implied_sql())
def implied_fk(spark, sf_dir):
    """All these columns overlap, so a pass that looks for disjoint ones finds none."""
    tables = T.from_directory(spark, sf_dir)
    return implied_foreign_keys(tables, _CHILDREN, _PARENTS, prune="none")


@query(_implied_sql())
def implied_fk_pruned(spark, sf_dir):
    """The same rows after ruling out what shares no value for certain."""
    tables = T.from_directory(spark, sf_dir)
    return implied_foreign_keys(tables, _CHILDREN, _PARENTS, prune="sketches")


_ROW_CHECKS_SQL = """
    SELECT 'rows' AS metric, count(*) AS value FROM lineitem
    UNION ALL SELECT 'nulls', count(*) FILTER (l_shipdate IS NULL OR l_returnflag IS NULL)
        FROM lineitem
    UNION ALL SELECT 'ranges', count(*) FILTER (l_quantity < 5 OR l_quantity > 45
        OR l_discount < 0 OR l_discount > 0.09) FROM lineitem
    UNION ALL SELECT 'dates', count(*) FILTER (l_shipdate < TIMESTAMP '1994-01-01'
        OR l_shipdate > TIMESTAMP '2000-12-31') FROM lineitem
    UNION ALL SELECT 'patterns', count(*) FILTER (NOT regexp_matches(l_returnflag, '^[AN]$'))
        FROM lineitem
"""


@query(_ROW_CHECKS_SQL)
def fused_row_checks(spark, sf_dir):
    lineitem = load(spark, sf_dir, "lineitem")
    return rowchecks.fused_counts(lineitem, row_check_predicates(spark, lineitem))


@query(_ROW_CHECKS_SQL)
def row_checks_while_written(spark, sf_dir):
    """The same counts, taken while the table is written."""
    lineitem = load(spark, sf_dir, "lineitem")
    path = shared_dir(spark, "checked-load")
    return rowchecks.counts_while_written(
        lineitem, row_check_predicates(spark, lineitem), lambda df: df.write.parquet(path)
    )


def row_check_predicates(spark, lineitem):
    schema = lineitem.schema
    ranges = {"l_quantity": {"min": 5, "max": 45}, "l_discount": {"min": 0, "max": 0.09}}
    dates = {"l_shipdate": {"min_date": "1994-01-01", "max_date": "2000-12-31"}}
    return {
        "nulls": P.null_predicate(schema, ["l_shipdate", "l_returnflag"]),
        "ranges": P.numeric_range_predicate(schema, ranges),
        "dates": P.date_range_predicate(spark, schema, dates),
        "patterns": P.pattern_predicate(spark, schema, {"l_returnflag": "^[AN]$"}),
    }


def _profile_sql() -> str:
    def column(name: str, kind: str) -> str:
        numeric, text = kind in ("INTEGER", "FLOAT"), kind == "STRING"
        number = f"CAST({name} AS DOUBLE)"
        integer_like = f"count(*) FILTER (regexp_matches({name}, '^-?[0-9]+$'))"
        return f"""
            SELECT '{name}' AS column_name, '{kind}' AS kind, count(*) AS rows,
                   count({name}) AS n_values, count(*) - count({name}) AS n_nulls,
                   {f'min({number})' if numeric else 'NULL'} AS low,
                   {f'max({number})' if numeric else 'NULL'} AS high,
                   {f'round(avg({number}), 4)' if numeric else 'NULL'} AS mean,
                   {f'round(stddev_samp({number}), 4)' if numeric else 'NULL'} AS stddev,
                   {f'min({name})' if text else 'NULL'} AS first_text,
                   {integer_like if text else 'NULL'} AS n_integer
            FROM orders"""

    return " UNION ALL ".join(
        column(n, k)
        for n, k in [
            ("o_orderkey", "INTEGER"), ("o_custkey", "INTEGER"), ("o_orderstatus", "STRING"),
            ("o_totalprice", "FLOAT"), ("o_orderdate", "DATETIME"),
            ("o_orderpriority", "STRING"),
        ]
    )


@query(_profile_sql())
def column_profile(spark, sf_dir):
    numeric, text = F.col("kind").isin("INTEGER", "FLOAT"), F.col("kind") == "STRING"
    return profile(load(spark, sf_dir, "orders")).select(
        "column_name", "kind", "rows", "n_values", "n_nulls",
        F.when(numeric, F.col("min_value").try_cast("double")).alias("low"),
        F.when(numeric, F.col("max_value").try_cast("double")).alias("high"),
        F.round("mean", 4).alias("mean"),
        F.round("stddev", 4).alias("stddev"),
        F.when(text, F.col("min_value")).alias("first_text"),
        F.col("n_integer"),
    )


#: What a load did to the customers: some balances, nations and segments are wrong.
_DRIFTED = {
    "c_acctbal": "CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END",
    "c_nationkey": "CASE WHEN c_acctbal < 0 THEN -1 - c_nationkey ELSE c_nationkey END",
    "c_mktsegment": "CASE WHEN c_acctbal > 9000 THEN lower(c_mktsegment) ELSE c_mktsegment END",
}


@query(f"""
    WITH learnt AS (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high,
                           min(c_nationkey) AS nlow, max(c_nationkey) AS nhigh FROM customer),
    loaded AS (SELECT {", ".join(f"{sql} AS {c}" for c, sql in _DRIFTED.items())} FROM customer)
    SELECT column_name, 'completeness' AS test_category, 0 AS estimated_failures
    FROM (VALUES ('c_custkey'), ('c_name'), ('c_nationkey'), ('c_acctbal'), ('c_mktsegment'))
         AS c(column_name)
    UNION ALL SELECT 'c_custkey', 'integrity', 0
    UNION ALL SELECT 'c_name', 'integrity', 0
    UNION ALL SELECT 'c_acctbal', 'quality', count(*) FILTER (c_acctbal < low OR c_acctbal > high)
        FROM loaded, learnt
    UNION ALL SELECT 'c_nationkey', 'quality',
        count(*) FILTER (c_nationkey < nlow OR c_nationkey > nhigh) FROM loaded, learnt
    UNION ALL SELECT 'c_mktsegment', 'business', count(*) FILTER (
        c_mktsegment NOT IN (SELECT c_mktsegment FROM customer)) FROM loaded
""")
def suggested_checks(spark, sf_dir):
    """Learnt from all customers, counted on all rows of a load that changed them."""
    customer = load(spark, sf_dir, "customer")
    loaded = customer.select(
        *(F.expr(_DRIFTED.get(c, c)).alias(c) for c in customer.columns)
    )
    found = suggest_checks("customers", loaded, "customer", learn_from=customer)
    return found.select("column_name", "test_category", "estimated_failures")
