import pytest
from pyspark.sql import functions as F

from tablecheck import Mapping, run_suite
from tablecheck.functions import typing as Y
from tablecheck.operators import conformance as C
from tablecheck.operators.profile import column_profile
from tablecheck.plans.conformance import required_columns, schema_summary, validate_schema
from tablecheck.plans.suggestions import suggest_checks
from tablecheck.sources import tables as T


@pytest.fixture
def tables(spark):
    orders = spark.createDataFrame(
        [(1, "7", "x", 1.5), (2, "8", "9", 2.5), (3, None, "3", None)],
        "ID bigint, customer string, code string, price double")
    customers = spark.createDataFrame([(7,), (8,), (9,)], "id int")
    return T.from_frames({"orders": orders, "customers": customers})


MODEL = [
    ("orders", "id", "INT64", False, None, None),
    ("orders", "customer", "STRING", True, None, None),
    ("orders", "code", "INT64", True, None, None),
    ("orders", "price", "FLOAT64", True, None, None),
    ("orders", "placed", "TIMESTAMP", True, None, None),
    ("invoices", "id", "INT64", True, None, None),
]


def test_findings(spark, tables):
    model = spark.createDataFrame(MODEL, C.MODEL_SCHEMA)
    findings = validate_schema(
        spark, model, tables, ["orders", "customers", "unreadable"],
        key_candidates=([("orders", "customer")], [("customers", "id")]),
    )
    got = sorted((r.test_name, r.status, r.table_name, r.column_name or "", r.rows_violating)
                 for r in findings.collect())
    assert got == [
        ("Implied foreign key", "INFO", "orders", "customer", 0),
        ("Missing column", "FAIL", "orders", "placed", 0),
        ("Missing table", "FAIL", "invoices", "", 0),
        ("Values of the wrong type", "FAIL", "orders", "code", 1),
        ("Wrong column type", "FAIL", "orders", "code", 0),
    ]
    assert schema_summary(findings, 2).first().asDict() == {"total_tables": 2, "total_issues": 5}
    declared = MODEL[:1] + [("orders", "customer", "STRING", True, "customers", "id")]
    again = validate_schema(
        spark, spark.createDataFrame(declared, C.MODEL_SCHEMA), tables, ["orders"],
        key_candidates=([("orders", "customer")], [("customers", "id")]),
    )
    assert {(r.test_name, r.column_name) for r in again.collect()} == {
        ("Undeclared column", "code"), ("Undeclared column", "price")}


def test_required_columns_come_from_the_model(spark, tables):
    model = spark.createDataFrame(
        [("orders", "id", "INT64", False, None, None),
         ("orders", "price", "FLOAT64", False, None, None),
         ("orders", "code", "STRING", True, None, None)], C.MODEL_SCHEMA)
    required = required_columns(model)
    assert {t: sorted(c) for t, c in required.items()} == {"orders": ["id", "price"]}
    load = Mapping("m", tables("orders"), "orders", auto_suggest=False)
    results = run_suite(spark, [load], tables, required).results
    assert results.where("test_id = 'no_nulls_required'").first().rows_violating == 1


def test_values_that_do_not_convert(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", [1]), ("x", "soon", [2]), (None, None, None)],
        "n string, d string, a array<int>")
    got = {r.column_name: (r.n_values, r.unconvertible)
           for r in C.type_conformance(df, {"n": "INT64", "d": "DATE", "a": "STRING"}).collect()}
    assert got == {"n": (2, 1), "d": (2, 1), "a": (2, 2)}
    same = C.type_conformance(df, {"a": "array<int>"}).first()
    assert (same.n_values, same.unconvertible) == (2, 0)


def test_declared_type_names():
    assert Y.kind_of(Y.WAREHOUSE_TYPES["BIGNUMERIC"]) == Y.FLOAT
    assert Y.is_id_name("width") and Y.is_id_name("paid") and not Y.is_id_name("name")


def test_profile_of_awkward_columns(spark):
    df = spark.createDataFrame(
        [(1, "a@b.co", None, [1], 1.0), (2, "c@d.org", None, None, float("nan")),
         (None, None, None, [], None)],
        "`odd name` int, mail string, empty string, list array<int>, v double")
    got = {r.column_name: r for r in column_profile(df).collect()}
    assert got["odd name"].n_nulls == 1 and got["odd name"].mean == 1.5
    assert got["mail"].n_email == 2 and got["mail"].n_url == 0
    assert got["empty"].n_values == 0 and got["empty"].min_value is None
    assert got["list"].n_values == 2 and got["list"].approx_distinct is None


def test_profile_of_a_wide_table(spark):
    wide = spark.range(30).select(*((F.col("id") * i).alias(f"c{i}") for i in range(95)))
    rows = column_profile(wide).orderBy("position").collect()
    assert [r.column_name for r in rows] == wide.columns
    assert all(r.max_value == str(29 * i) and r.n_values == 30 for i, r in enumerate(rows))


def test_suggestions_learn_from_the_source_and_count_target_failures(spark):
    source = spark.range(200).select(
        "id", F.concat(F.lit("u"), F.col("id"), F.lit("@x.org")).alias("mail"),
        (F.col("id") % 50).cast("double").alias("score"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b'").alias("grade"),
        F.when(F.col("id") > 0, F.lit("x")).alias("note"))
    bad = spark.createDataFrame([(5, "nobody", 99.0, "c", None)], source.schema)
    target = source.unionByName(bad)
    got = {(r.column_name, r.test_category, r.test_name): r
           for r in suggest_checks("m", target, "tgt", learn_from=source).collect()}
    failures = {k[:2]: r.estimated_failures for k, r in got.items() if k[0] != "note"}
    assert failures == {
        ("id", "completeness"): 0, ("id", "integrity"): 1, ("mail", "completeness"): 0,
        ("mail", "integrity"): 0, ("mail", "quality"): 1, ("score", "completeness"): 0,
        ("score", "quality"): 1, ("grade", "completeness"): 0, ("grade", "business"): 1,
    }
    assert [k[1] for k in got if k[0] == "note"] == ["business"]
    target.createOrReplaceTempView("tgt")
    for r in got.values():
        assert spark.sql(r.sql_query).count() == r.estimated_failures, r.sql_query
    fewer = suggest_checks("m", target, "tgt", source, already=[("id", "integrity")]).collect()
    assert len(fewer) == len(got) - 1


def test_no_suggestions_for_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, t string")
    assert suggest_checks("m", empty, "e").count() == 0


def test_narrower_types_lossy_values_and_bad_key_candidates(spark):
    from tablecheck.operators import conformance
    from tablecheck.plans.conformance import validate_schema
    from tablecheck.sources import tables as T

    rows = spark.createDataFrame([(1, 1.5, "a"), (1 << 40, 2.0, "b")], "k long, x double, s string")
    frames = T.from_frames({"t": rows, "u": rows.selectExpr("cast(1 AS int) AS k", "x", "s")})
    model = spark.createDataFrame(
        [("t", "k", "int", True, None, None), ("t", "x", "INT64", True, None, None),
         ("t", "s", "STRING", True, None, None)], conformance.MODEL_SCHEMA)
    found = validate_schema(spark, model, frames, ["t"], key_candidates=(
        [("t", "x"), ("t", "s"), ("t", "gone")], [("u", "s")])).collect()
    counts = {(r.test_name, r.column_name): r.rows_violating for r in found}
    assert counts["Values of the wrong type", "k"] == 1
    assert counts["Values of the wrong type", "x"] == 1
    assert ("Not a possible key", "x") in counts and ("Not a possible key", "gone") in counts
    assert ("Implied foreign key", "s") in counts
