"""Configuration, source files and schemas, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecheck import run_single_file
from tablecheck.functions.predicates import null_predicate
from tablecheck.operators import conformance
from tablecheck.operators.rowchecks import fused_counts
from tablecheck.plans import runner, specs
from tablecheck.plans.conformance import validate_schema
from tablecheck.session import shared_dir
from tablecheck.sources import files, stores, tables as T
from tablecheck.sources.files import SourceFiles

from .registered import load, query

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# A customer's own target table: its columns, with their kinds and modes.
_COLUMNS = """
    SELECT concat('t', c_custkey) AS table_name, 0 AS position, 'Id' AS column_name,
           'INTEGER' AS kind, 'REQUIRED' AS mode FROM customer
    UNION ALL SELECT concat('t', c_custkey), 1, concat('T', c_custkey, '_ID'), 'STRING',
        CASE WHEN c_acctbal > 0 THEN 'REQUIRED' ELSE 'NULLABLE' END FROM customer
    UNION ALL SELECT concat('t', c_custkey), 2, 'amount',
        CASE WHEN c_nationkey > 12 THEN 'FLOAT' ELSE 'NUMERIC' END, 'NULLABLE' FROM customer
    UNION ALL SELECT concat('t', c_custkey), 3, 'segment', 'STRING', 'NULLABLE' FROM customer
        WHERE c_mktsegment <> 'BUILDING'"""

_ACTIVE = """CASE WHEN c_acctbal >= 0 THEN TRUE WHEN c_acctbal < -500 THEN FALSE END"""


def _config(spark, sf_dir):
    """A configuration table with one mapping per customer."""
    low, high = F.col("c_custkey").cast("double"), F.col("c_custkey") + F.lit(0.5)
    ids = F.when(
        F.col("c_mktsegment") == "BUILDING",
        F.array(F.lit("numeric_range"), F.lit("gone"), F.lit("row_count_match"),
                F.lit("numeric_range")),
    ).when(
        F.col("c_mktsegment") == "MACHINERY",
        F.array(F.lit("pattern_validation"), F.lit("date_range"), F.lit("referential_integrity")),
    ).otherwise(F.array().cast("array<string>"))
    return load(spark, sf_dir, "customer").select(
        F.col("c_name").alias("mapping_id"),
        F.col("c_mktsegment").alias("description"),
        F.lower("c_mktsegment").alias("target_table"),
        F.expr(_ACTIVE).alias("is_active"),
        F.when(F.col("c_nationkey") > 4, F.array(F.lit("id"))).alias("primary_key_columns"),
        F.array().cast("array<string>").alias("required_columns"),
        F.lit(None).cast("array<string>").alias("outlier_columns"),
        ids.alias("enabled_test_ids"),
        F.to_json(
            F.create_map(F.lit("balance"), F.struct(low.alias("min"), high.alias("max")))
        ).alias("numeric_range_checks"),
        F.lit(None).cast("string").alias("date_range_checks"),
        F.to_json(
            F.create_map(
                F.lit("nation"),
                F.struct(F.lower("c_mktsegment").alias("table"), F.lit("n_key").alias("column")),
            )
        ).alias("foreign_key_checks"),
        F.when(F.col("c_nationkey") == 7, F.concat(F.lit('{"name": '), F.col("c_name")))
        .otherwise(F.to_json(F.create_map(F.lit("name"), F.concat(F.lit("^"), F.col("c_name")))))
        .alias("pattern_checks"),
    )


@query(f"SELECT c_name AS mapping_id, c_mktsegment AS description FROM customer WHERE {_ACTIVE}")
def active_mappings(spark, sf_dir):
    return stores.active_mappings(_config(spark, sf_dir)).select("mapping_id", "description")


@query("""
    SELECT c_name AS mapping_id, 'numeric_range' AS test_id, 'balance' AS column_name,
           CAST(c_custkey AS DOUBLE) AS "min", c_custkey + CAST(0.5 AS DOUBLE) AS "max",
           NULL AS pattern, NULL AS ref_table, NULL AS ref_column FROM customer
    UNION ALL
    SELECT c_name, 'referential_integrity', 'nation', NULL, NULL, NULL, lower(c_mktsegment),
           'n_key' FROM customer
    UNION ALL
    SELECT c_name, 'pattern_validation', 'name', NULL, NULL, '^' || c_name, NULL, NULL
    FROM customer WHERE c_nationkey <> 7
""")
def config_check_specs(spark, sf_dir):
    return specs.check_specs(_config(spark, sf_dir)).drop("min_date", "max_date")


@query("""
    SELECT c_name AS mapping_id, 'pattern_checks' AS setting FROM customer WHERE c_nationkey = 7
""")
def config_broken_settings(spark, sf_dir):
    return specs.broken_settings(_config(spark, sf_dir))


@query("""
    SELECT c_name AS mapping_id,
           CASE WHEN c_nationkey = 3 THEN 'Id' ELSE 'Id,T' || c_custkey || '_ID' END
               AS key_columns,
           CASE WHEN c_acctbal > 0 THEN 'Id,T' || c_custkey || '_ID' ELSE 'Id' END
               AS required_columns,
           'Id,amount' AS outlier_columns
    FROM customer
""")
def inferred_settings(spark, sf_dir):
    """Key, required and outlier columns inferred for one target table per customer; the
    key name only counts where the table's own name is written in lower case."""
    customer = load(spark, sf_dir, "customer")
    name = F.concat(F.lit("t"), F.col("c_custkey").cast("string"))
    upper = F.col("c_nationkey") == 3
    columns = spark.sql(_COLUMNS.replace("FROM customer", "FROM {customer}"), customer=customer)
    targets = customer.select(
        F.col("c_name").alias("mapping_id"), F.when(upper, F.upper(name)).otherwise(name)
        .alias("target_table"),
    )
    shouted = customer.where(upper).select(name.alias("table_name"))
    columns = columns.join(shouted.withColumn("shout", F.lit(True)), "table_name", "left")
    columns = columns.withColumn(
        "table_name", F.when(F.col("shout"), F.upper("table_name")).otherwise(F.col("table_name"))
    )
    found = specs.infer_settings(targets, columns.drop("shout"))
    return found.select(
        "mapping_id",
        F.array_join("primary_key_columns", ",").alias("key_columns"),
        F.array_join("required_columns", ",").alias("required_columns"),
        F.array_join("outlier_columns", ",").alias("outlier_columns"),
    )


@query("""
    WITH listed(segment, position, test_id, severity) AS (VALUES
        ('BUILDING', 0, 'numeric_range', 'MEDIUM'), ('BUILDING', 2, 'row_count_match', 'HIGH'),
        ('BUILDING', 3, 'numeric_range', 'MEDIUM'),
        ('MACHINERY', 0, 'pattern_validation', 'MEDIUM'), ('MACHINERY', 1, 'date_range', 'MEDIUM'),
        ('MACHINERY', 2, 'referential_integrity', 'HIGH'),
        (NULL, 0, 'row_count_match', 'HIGH'), (NULL, 1, 'no_nulls_required', 'HIGH'),
        (NULL, 2, 'no_duplicates_pk', 'HIGH'))
    SELECT c_name AS mapping_id, position, test_id, severity FROM customer JOIN listed
        ON segment = c_mktsegment
        OR (segment IS NULL AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))
""")
def enabled_checks(spark, sf_dir):
    return specs.enabled_checks(_config(spark, sf_dir)).select(
        "mapping_id", "position", "test_id", "severity"
    )


_PLANNED_SQL = """
    SELECT c_name AS mapping_id, 0 AS position, 'row_count_match' AS test_id FROM customer
    UNION ALL SELECT c_name, 1, 'numeric_range' FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT c_name, 4, 'numeric_range' FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT c_name, 1, 'pattern_validation' FROM customer
        WHERE c_mktsegment = 'MACHINERY' AND c_nationkey <> 7
    UNION ALL SELECT c_name, 3, 'referential_integrity' FROM customer
        WHERE c_mktsegment = 'MACHINERY'
    UNION ALL SELECT c_name, 3, 'no_duplicates_pk' FROM customer
        WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_nationkey > 4
"""


@query(_PLANNED_SQL)
def planned_checks(spark, sf_dir):
    return specs.planned_checks(_config(spark, sf_dir)).select("mapping_id", "position", "test_id")


@query(f"SELECT * FROM ({_PLANNED_SQL}) WHERE mapping_id IN (SELECT c_name FROM customer WHERE c_nationkey <> 7)")
def planned_checks_of_the_runner(spark, sf_dir):
    """What the runner itself plans for each row of the same configuration. It refuses the
    rows whose settings do not parse, which is those of one nation."""
    target = runner.TableSchema(spark.createDataFrame([], "balance double, nation int, name string").schema)
    parents = runner.TableSchema(spark.createDataFrame([], "n_key int").schema)

    def planned(rows):
        for row in rows:
            try:
                mapping = runner.Mapping.from_row(row)
            except ValueError:
                continue
            loaded = runner.LoadedMapping(None, mapping, target, lambda name: parents)
            yield mapping.mapping_id, 0, "row_count_match"
            for p in runner.plan_mapping(loaded):
                yield mapping.mapping_id, p.position, p.check.test_id

    source = {f"source_{n}": F.lit(v) for n, v in (("bucket", "b"), ("file_path", "f.csv"), ("file_format", "csv"))}
    config = _config(spark, sf_dir).withColumns({**source, "target_dataset": F.lit(None).cast("string")})
    # a row is planned in a task, from schemas alone; a small file would be a single task
    dealt = config.repartition(spark.sparkContext.defaultParallelism)
    return spark.createDataFrame(
        dealt.rdd.mapPartitions(planned), "mapping_id string, position int, test_id string"
    )


@query("""
    SELECT c_name AS mapping_id, c_mktsegment AS description FROM customer
    WHERE c_mktsegment <> 'BUILDING'
""")
def mapping_deactivation(spark, sf_dir):
    """Mappings stored, those of one segment switched off, the active ones read back."""
    store = stores.config_store(spark, shared_dir(spark, "config"))
    stores.add_mappings(store, _config(spark, sf_dir).withColumn("is_active", F.lit(True)))
    store.change(
        "description = 'BUILDING'", is_active=F.lit(False), updated_at=F.current_timestamp()
    )
    return stores.active_mappings(store.read()).select("mapping_id", "description")


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS mapping_id, p_name AS test_name, status,
           estimated_failures
    FROM (SELECT *, CAST(p_size AS BIGINT) AS estimated_failures,
                 CASE WHEN p_size > 40 THEN 'approved' WHEN p_brand = 'Brand#2' THEN 'rejected'
                      ELSE 'pending' END AS status FROM part)
    WHERE status <> 'rejected'
""")
def suggestion_review(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("mapping_id"),
        F.col("p_name").alias("test_name"),
        F.col("p_brand").alias("test_category"),
        F.lit("LOW").alias("severity"),
        F.lit("SELECT 1").alias("sql_query"),
        F.col("p_size").cast("long").alias("estimated_failures"),
    )
    store = stores.suggestion_store(spark, shared_dir(spark, "suggestions"))
    stores.add_suggestions(store, rows)
    stores.review_suggestions(store, "test_category = 'Brand#2'", "rejected", "qa")
    stores.review_suggestions(store, "estimated_failures > 40", "approved", "qa", "fine")
    approved = store.read().where("status = 'approved'")
    pending = stores.pending_suggestions(store.read())
    return approved.unionByName(pending).select(
        "mapping_id", "test_name", "status", "estimated_failures"
    )


@query("""
    SELECT event_id, 'k' AS setting, CAST(json_extract(props, '$.k') AS DOUBLE) AS bound
    FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 90
""")
def json_config_explode(spark, sf_dir):
    """Settings of one mapping for each event, decoded and exploded; numbers as text too."""
    number = F.get_json_object("props", "$.k")
    as_text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), number, F.lit('"')))
    bound = F.coalesce(as_text, number)
    config = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("mapping_id"),
        F.concat(F.lit('{"k": {"min": '), bound, F.lit("}}")).alias("numeric_range_checks"),
        *(F.lit(None).cast("string").alias(name)
          for name in ("date_range_checks", "foreign_key_checks", "pattern_checks")),
    )
    return specs.check_specs(config).select(
        F.col("mapping_id").alias("event_id"), F.col("column_name").alias("setting"),
        F.col("min").alias("bound"),
    ).where("bound > 90")


@query("""
    SELECT 'csv' AS format, count(*) AS rows FROM events
    UNION ALL SELECT 'json', count(*) FROM events
    UNION ALL SELECT 'parquet', count(*) FROM events
""")
def source_row_counts(spark, sf_dir):
    """A table written in every built-in format, its files counted again."""
    events = load(spark, sf_dir, "events")
    counts = None
    for fmt in ("csv", "json", "parquet"):
        root = shared_dir(spark, f"source-{fmt}")
        writer = events.write.format(fmt).option("escape", '"')
        (writer.option("header", "true") if fmt == "csv" else writer).save(root)
        found = files.count_by_file(spark, SourceFiles(root, f"part-*.{fmt}", fmt))
        total = found.agg(F.sum("rows").alias("rows")).select(F.lit(fmt).alias("format"), "rows")
        counts = total if counts is None else counts.unionByName(total)
    return counts


@query("""
    SELECT count(*) AS rows, CAST(0 AS BIGINT) AS malformed_rows,
           CAST(sum(length(text)) AS BIGINT) AS characters FROM documents
""")
def source_multiline_csv(spark, sf_dir):
    """Texts with line breaks and quotes, through CSV and back without loss."""
    root = shared_dir(spark, "source-texts")
    documents = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    documents.write.option("header", "true").option("escape", '"').csv(root)
    source = SourceFiles(root, "*.csv", multiline=True)
    counts = files.count_by_file(spark, source).agg(
        F.sum("rows").alias("rows"), F.sum("malformed_rows").alias("malformed_rows")
    )
    characters = files.read(spark, source).agg(F.sum(F.length("text")).alias("characters"))
    return counts.withColumn("characters", characters.scalar())


@query("""
    SELECT row_number() OVER () - 1 AS position, name AS column_name, n AS filled FROM (
        SELECT 'o_orderkey' AS name, count(o_orderkey) AS n FROM orders
        UNION ALL SELECT 'o_orderpriority', count(o_orderpriority) FROM orders
        UNION ALL SELECT 'o_totalprice', count(o_totalprice) FROM orders)
""")
def source_columns(spark, sf_dir):
    """The columns of a source's files, with how many rows have a value in each."""
    root = shared_dir(spark, "source-columns")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    orders.write.option("header", "true").csv(root)
    source = SourceFiles(root, "*.csv")
    names = files.columns(spark, source)
    counts = files.read(spark, source).agg(*(F.count(c).alias(c) for c in names))
    cells = (
        F.struct(F.lit(i).cast("long").alias("position"), F.lit(c).alias("column_name"), F.col(c).alias("filled"))
        for i, c in enumerate(names)
    )
    return counts.select(F.inline(F.array(*cells)))


#: Text that one task writes to one file; ranges of a file are smaller.
ONE_FILE_BYTES = 512 << 20


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS malformed_rows FROM documents")
def source_multiline_ranges(spark, sf_dir):
    """Texts with line breaks and quotes in one file, counted range by range; more text
    than a task should write makes several files, each of several ranges."""
    root = shared_dir(spark, "source-one-file")
    documents = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files_written = max(1, -(-size // ONE_FILE_BYTES))
    # round robin, as files of equal size are wanted; a single one needs no shuffle
    dealt = documents.coalesce(1) if files_written == 1 else documents.repartition(files_written)
    dealt.write.option("header", "true").option("escape", '"').csv(root)
    counts = files.count_by_file(spark, SourceFiles(root, "*.csv", multiline=True))
    return counts.agg(
        F.sum("rows").alias("rows"), F.sum("malformed_rows").alias("malformed_rows")
    )


@query("""
    SELECT o_orderstatus AS folder, count(*) AS rows FROM orders
    WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus
""")
def source_wildcard(spark, sf_dir):
    """Rows per folder of the files a star pattern selects."""
    root = shared_dir(spark, "source-orders")
    orders = load(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus"))
    orders.write.option("header", "true").partitionBy("status").csv(root)
    source = SourceFiles(root, "status=[FO]/part-*.csv")
    folder = F.regexp_extract("path", "status=([A-Z])/", 1).alias("folder")
    return files.count_by_file(spark, source).groupBy(folder).agg(F.sum("rows").alias("rows"))


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority
    FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 5
""")
def source_head_sample(spark, sf_dir):
    root = shared_dir(spark, "source-sample")
    load(spark, sf_dir, "orders").write.option("header", "true").csv(root)
    rows = files.read(spark, SourceFiles(root, "*.csv"))
    return T.head(rows, 5, order_by=["o_orderkey"]).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority"
    )


@query("""
    SELECT * FROM orders ORDER BY o_orderkey LIMIT 5
""")
def table_head_sample(spark, sf_dir):
    return T.head(load(spark, sf_dir, "orders"), 5, order_by=["o_orderkey"])


_COLUMN_COUNTS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
    "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2,
    "labels": 3, "conversations": 4,
}


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({n} AS BIGINT) AS num_columns, count(*) AS num_rows FROM {t}"
    for t, n in _COLUMN_COUNTS.items()
))
def table_metadata(spark, sf_dir):
    found = T.metadata(T.from_directory(spark, sf_dir), TABLES)
    return found.select("table_name", "num_columns", "num_rows")


_FILLED = ("customer", "orders", "lineitem", "events", "documents", "conversations")
_NULLED = {"events": ("value", "value > 50"), "orders": ("o_custkey", "o_totalprice > 200000")}


def _columns_sql() -> str:
    columns = {
        "customer": "c_custkey:INTEGER c_name:STRING c_nationkey:INTEGER c_acctbal:FLOAT"
        " c_mktsegment:STRING",
        "orders": "o_orderkey:INTEGER o_custkey:INTEGER o_orderstatus:STRING o_totalprice:FLOAT"
        " o_orderdate:DATETIME o_orderpriority:STRING",
        "lineitem": "l_orderkey:INTEGER l_partkey:INTEGER l_suppkey:INTEGER l_linenumber:INTEGER"
        " l_quantity:FLOAT l_extendedprice:FLOAT l_discount:FLOAT l_tax:FLOAT"
        " l_returnflag:STRING l_linestatus:STRING l_shipdate:DATETIME",
        "events": "event_id:INTEGER ts:DATETIME user_id:INTEGER event_type:STRING value:FLOAT"
        " props:STRING",
        "documents": "doc_id:INTEGER text:STRING lang:STRING source:STRING n_chars:INTEGER",
        "conversations": "conv_id:INTEGER turn:INTEGER role:STRING text:STRING",
    }

    def nulls(table: str, column: str) -> str:
        name, condition = _NULLED.get(table, (None, None))
        return f"count(*) FILTER ({condition})" if name == column else "count(*) FILTER (FALSE)"

    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, '{k}' AS kind,"
        f" '{'REQUIRED' if i == 0 else 'NULLABLE'}' AS mode, {nulls(t, c)} AS n_nulls FROM {t}"
        for t in _FILLED
        for i, (c, k) in enumerate(x.split(":") for x in columns[t].split())
    )


@query(_columns_sql())
def table_columns(spark, sf_dir):
    """The columns of several tables, with the NULLs found in each."""
    frames = {t: load(spark, sf_dir, t) for t in _FILLED}
    for t, (column, condition) in _NULLED.items():
        kept = F.when(~F.expr(condition), F.col(column))
        frames[t] = frames[t].withColumn(column, kept)
    required = {t: [df.columns[0]] for t, df in frames.items()}
    columns = T.columns(spark, T.from_frames(frames), (*_FILLED, "no_such_table"), required)
    counts = None
    for t, df in frames.items():
        found = fused_counts(df, {c: null_predicate(df.schema, [c]) for c in df.columns})
        found = found.select(
            F.lit(t).alias("table_name"), F.col("metric").alias("column_name"),
            F.col("value").alias("n_nulls"),
        )
        counts = found if counts is None else counts.unionByName(found)
    return columns.drop("data_type").join(counts, ["table_name", "column_name"])


@query("""
    WITH doc AS (SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l
                 ON d.doc_id = l.doc_id)
    SELECT 'row_count_match' AS test_id, 'PASS' AS status, CAST(0 AS BIGINT) AS rows_violating
    UNION ALL
    SELECT 'no_nulls_required', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*)
    FROM doc WHERE doc_id IS NULL OR quality IS NULL
    UNION ALL
    SELECT 'no_duplicates_pk', 'PASS', 0
""")
def single_file_comparison(spark, sf_dir):
    """A table written as CSV against its target, with the default checks."""
    documents = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    root = shared_dir(spark, "source-documents")
    documents.write.option("header", "true").csv(root)
    target = documents.join(load(spark, sf_dir, "labels"), "doc_id", "left")
    run = run_single_file(
        spark, SourceFiles(root, "part-*.csv"), "shop.doc", T.from_frames({"shop.doc": target}),
        required=["doc_id", "quality"], auto_suggest=False,
    )
    return run.results.select("test_id", "status", "rows_violating")


KEY_CANDIDATES = (
    [("nation", "n_regionkey"), ("customer", "c_nationkey"), ("lineitem", "l_partkey")],
    [("region", "r_regionkey"), ("nation", "n_nationkey"), ("part", "p_partkey")],
)

_MODEL = [
    ("customer", "c_custkey", "bigint", False, None, None),
    ("customer", "c_name", "BIGNUMERIC", False, None, None),
    ("customer", "c_nationkey", "INT64", False, "nation", "n_nationkey"),
    ("customer", "c_acctbal", "FLOAT64", True, None, None),
    ("customer", "c_phone", "STRING", True, None, None),
    ("invoice", "i_id", "INT64", False, None, None),
    ("part", "p_partkey", "bigint", False, None, None),
    ("part", "p_type", "STRING", True, None, None),
    ("part", "p_brand", "INT64", True, None, None),
    ("part", "p_size", "STRING", True, None, None),
    ("part", "p_retailprice", "double", True, None, None),
    ("part", "p_name", "STRING", True, None, None),
    ("nation", "n_nationkey", "INT64", False, None, None),
    ("nation", "n_name", "STRING", False, None, None),
    ("nation", "n_regionkey", "INT64", False, None, None),
]


@query("""
    SELECT 'Missing table' AS test_name, 'FAIL' AS status, 'HIGH' AS severity,
           'invoice' AS table_name, NULL AS column_name, 0 AS rows_violating
    UNION ALL SELECT 'Missing column', 'FAIL', 'HIGH', 'customer', 'c_phone', 0
    UNION ALL SELECT 'Undeclared column', 'WARNING', 'LOW', 'customer', 'c_mktsegment', 0
    UNION ALL SELECT 'Wrong column type', 'FAIL', 'MEDIUM', 'customer', 'c_name', 0
    UNION ALL SELECT 'Wrong column type', 'FAIL', 'MEDIUM', 'part', 'p_brand', 0
    UNION ALL SELECT 'Wrong column type', 'FAIL', 'MEDIUM', 'part', 'p_size', 0
    UNION ALL SELECT 'Values of the wrong type', 'FAIL', 'MEDIUM', 'customer', 'c_name',
        count(*) FILTER (try_cast(c_name AS DOUBLE) IS NULL) FROM customer
    UNION ALL SELECT 'Values of the wrong type', 'FAIL', 'MEDIUM', 'part', 'p_brand',
        count(*) FILTER (try_cast(p_brand AS BIGINT) IS NULL) FROM part
    UNION ALL SELECT 'Implied foreign key', 'INFO', 'MEDIUM', t, c, 0 FROM (
        SELECT 'nation' AS t, 'n_regionkey' AS c, bool_and(n_regionkey IN (
            SELECT r_regionkey FROM region)) AS implied FROM nation
        UNION ALL SELECT 'nation', 'n_regionkey', bool_and(n_regionkey IN (
            SELECT n_nationkey FROM nation)) FROM nation
        UNION ALL SELECT 'nation', 'n_regionkey', bool_and(n_regionkey IN (
            SELECT p_partkey FROM part)) FROM nation
        UNION ALL SELECT 'customer', 'c_nationkey', bool_and(c_nationkey IN (
            SELECT p_partkey FROM part)) FROM customer
        UNION ALL SELECT 'lineitem', 'l_partkey', bool_and(l_partkey IN (
            SELECT p_partkey FROM part)) FROM lineitem
    ) WHERE implied
""")
def schema_findings(spark, sf_dir):
    """Tables against a declared model, with the foreign keys the data fully implies."""
    model = spark.createDataFrame(_MODEL, conformance.MODEL_SCHEMA)
    findings = validate_schema(
        spark, model, T.from_directory(spark, sf_dir), ("customer", "part", "nation", "region"),
        key_candidates=KEY_CANDIDATES,
    )
    return findings.select(
        "test_name", "status", "severity", "table_name", "column_name", "rows_violating"
    )
