import json

import pytest
from pyspark.sql import functions as F

from tablecheck import Mapping, SourceFiles, run_config, run_custom_checks, run_mapping
from tablecheck import run_single_file, run_suite, violations
from tablecheck.plans import registry, rollups, runner, specs
from tablecheck.sources import stores, tables as T

CONFIG = (
    "mapping_id string, target_table string, primary_key_columns array<string>,"
    " required_columns array<string>, outlier_columns array<string>,"
    " enabled_test_ids array<string>, numeric_range_checks string, date_range_checks string,"
    " foreign_key_checks string, pattern_checks string"
)


def config(spark, *rows):
    full = []
    for row in rows:
        base = dict.fromkeys(c.strip().split(" ")[0] for c in CONFIG.split(","))
        full.append(tuple({**base, **row}.values()))
    return spark.createDataFrame(full, CONFIG)


@pytest.fixture
def people(spark):
    rows = [
        (1, "a@x.org", 20, 1), (2, "b@x.org", 150, 1), (3, None, 30, 2), (3, "nope", 40, 9),
        (5, "e@x.org", None, None),
    ]
    return spark.createDataFrame(rows, "id int, email string, age int, team_id int")


@pytest.fixture
def tables(spark, people):
    teams = spark.createDataFrame([(1,), (2,)], "id int")
    return T.from_frames({"people": people, "ds.teams": teams})


def mapping(people, **settings):
    given = dict(
        source=people,
        auto_suggest=False,
        required_columns=("email",),
        numeric_range_checks={"age": {"min": 0, "max": 120}},
        foreign_key_checks={"team_id": {"table": "ds.teams", "column": "id"}},
        pattern_checks={"email": "^[^@]+@[^@]+$"},
        outlier_columns=("age",),
        enabled_test_ids=tuple(registry.BY_ID),
    )
    return Mapping("m", target_table="people", **{**given, **settings})


def outcome(run):
    return {
        r.test_id: (r.status, r.rows_affected) for r in run.results.orderBy("position").collect()
    }


def test_registry_listing(spark):
    listed = registry.listing(spark).collect()
    assert [r.test_id for r in listed] == [
        "row_count_match", "no_nulls_required", "no_duplicates_pk", "referential_integrity",
        "numeric_range", "date_range", "pattern_validation", "outlier_detection",
    ]
    assert [r.test_id for r in listed if r.is_global] == list(registry.SINGLE_FILE_CHECKS)


def test_results_of_one_mapping(spark, people, tables):
    run = run_mapping(spark, mapping(people), tables)
    assert outcome(run) == {
        "row_count_match": ("PASS", 0),
        "no_nulls_required": ("FAIL", 1),
        "no_duplicates_pk": ("FAIL", 1),
        "referential_integrity": ("FAIL", 1),
        "numeric_range": ("FAIL", 1),
        "pattern_validation": ("FAIL", 1),
        "outlier_detection": ("PASS", 0),
    }
    assert next(iter(outcome(run))) == "row_count_match"
    about = run.mappings.first()
    assert (about.file_row_count, about.table_row_count, about.error) == (5, 5, None)


def test_reported_sql_finds_as_many_rows(spark, people, tables):
    for name, df in (("people", people), ("teams", tables("ds.teams"))):
        df.createOrReplaceTempView(f"tc_{name}")
    m = mapping(people, foreign_key_checks={"team_id": {"table": "tc_teams", "column": "id"}},
                date_range_checks={"email": {"min_date": "a", "max_date": "b'z"}})
    m = Mapping(**{**m.__dict__, "target_table": "tc_people", "primary_key_columns": ("id",)})
    run = run_mapping(spark, m, T.from_catalog(spark))
    checked = [r for r in run.results.collect() if r.sql_query]
    assert len(checked) == 7
    for r in checked:
        assert r.status != "ERROR" and spark.sql(r.sql_query).count() == r.rows_violating, r.test_id


@pytest.mark.parametrize("cap, reported", [(None, 1000), (100, 100)])
def test_a_report_is_only_capped_on_request(spark, cap, reported):
    df = spark.range(1000).select(F.lit(None).cast("string").alias("v"), (F.col("id") % 300)
                                  .alias("id"))
    m = Mapping("m", df, "t", required_columns=("v",))
    run = run_mapping(spark, m, T.from_frames({"t": df}), report_cap=cap)
    results = {r.test_id: r for r in run.results.collect()}
    nulls, keys = results["no_nulls_required"], results["no_duplicates_pk"]
    assert (nulls.rows_affected, nulls.rows_violating) == (reported, 1000)
    assert (keys.rows_affected, keys.rows_violating) == (300, 300)


def test_one_bad_check_does_not_stop_the_others(spark, people, tables):
    bad = mapping(
        people,
        required_columns=("email", "no_such_column"),
        numeric_range_checks={"age": {"min": 0}},
        pattern_checks={"email": "(?=x)"},
    )
    got = outcome(run_mapping(spark, bad, tables))
    assert [k for k, v in got.items() if v[0] == "ERROR"] == [
        "no_nulls_required", "numeric_range", "pattern_validation"
    ]
    assert got["no_duplicates_pk"] == ("FAIL", 1)
    errors = {r.test_id: r.error_message for r in run_mapping(spark, bad, tables).results.collect()}
    assert "no_such_column" in errors["no_nulls_required"]


def test_a_check_that_fails_while_running_is_isolated(spark, people):
    broken = people.withColumn("parent", F.raise_error(F.lit("disk on fire")).cast("int"))
    tables = T.from_frames({"people": people, "ds.teams": broken})
    m = mapping(people, foreign_key_checks={"team_id": {"table": "ds.teams", "column": "parent"}})
    run = run_mapping(spark, m, tables)
    got = outcome(run)
    assert got["referential_integrity"] == ("ERROR", 0)
    assert got["numeric_range"] == ("FAIL", 1) and got["row_count_match"] == ("PASS", 0)
    error = run.results.where("status = 'ERROR'").first().error_message
    assert "disk on fire" in error


def test_checks_without_settings_are_skipped_and_unknown_ids_dropped(spark, people, tables):
    m = Mapping("m", people, "people", enabled_test_ids=("numeric_range", "nonsense", "date_range"))
    assert outcome(run_mapping(spark, m, tables)) == {"row_count_match": ("PASS", 0)}


def test_repeated_ids_run_twice_in_order(spark, people, tables):
    m = mapping(people, enabled_test_ids=("numeric_range", "no_nulls_required", "numeric_range"))
    rows = run_mapping(spark, m, tables).results.orderBy("position").collect()
    assert [r.test_id for r in rows] == [
        "row_count_match", "numeric_range", "no_nulls_required", "numeric_range"
    ]


def test_inferred_key_required_and_outlier_columns(spark, tables, people):
    m = Mapping("m", people.limit(3), "people", enabled_test_ids=(
        "no_nulls_required", "no_duplicates_pk", "outlier_detection"))
    run = run_suite(spark, [m], tables, {"people": ["email", "age"]})
    assert outcome(run) == {
        "row_count_match": ("FAIL", 2), "no_nulls_required": ("FAIL", 2),
        "no_duplicates_pk": ("FAIL", 1), "outlier_detection": ("PASS", 0),
    }
    assert specs.infer_key("Orders", ["orders_id", "GUID", "x"]) == ["GUID"]
    assert specs.infer_key("orders", ["Orders_ID", "id"]) == ["Orders_ID", "id"]


def test_inference_as_a_frame(spark, people):
    columns = T.columns(spark, T.from_frames({"people": people}), ["people"],
                        {"people": ["email"]})
    targets = spark.createDataFrame([("m", "people")], "mapping_id string, target_table string")
    got = specs.infer_settings(targets, columns).first()
    assert got.primary_key_columns == ["id"]
    assert got.required_columns == ["email"]
    assert got.outlier_columns == ["id", "age", "team_id"]


def test_a_mapping_that_cannot_be_read_has_an_error_and_no_results(spark, people, tables):
    run = run_suite(spark, [Mapping("gone", people, "nowhere"), mapping(people)], tables)
    assert {r.mapping_id for r in run.results.collect()} == {"m"}
    errors = {r.mapping_id: r.error for r in run.mappings.collect()}
    assert "nowhere" in errors["gone"] and errors["m"] is None
    with pytest.raises(ValueError, match="no active mappings"):
        run_suite(spark, [], tables)


def test_sequential_and_parallel_runs_agree(spark, people, tables):
    many = [Mapping(f"m{i}", people, "people", required_columns=("email",)) for i in range(6)]
    one = run_suite(spark, many, tables, parallel=1).results
    four = run_suite(spark, many, tables, parallel=4).results
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, four.collect()))


def test_violations_of_one_check(spark, people, tables):
    assert violations(spark, mapping(people), tables, "numeric_range").first().id == 2
    assert violations(spark, mapping(people), tables, "no_duplicates_pk").first().id == 3
    with pytest.raises(ValueError):
        violations(spark, mapping(people), tables, "date_range")


def test_single_file_against_a_table(spark, tmp_path, people):
    people.coalesce(1).write.option("header", "true").csv(str(tmp_path / "src"))
    source = SourceFiles(str(tmp_path), "src/*.csv")
    run = run_single_file(spark, source, "people", T.from_frames({"people": people}), ["email"])
    assert outcome(run) == {"row_count_match": ("PASS", 0), "no_nulls_required": ("FAIL", 1),
                            "no_duplicates_pk": ("FAIL", 1)}
    lost = run_single_file(spark, SourceFiles(str(tmp_path), "no_*.csv"), "people",
                           T.from_frames({"people": people}))
    assert lost.results.count() == 0 and lost.mappings.first().error


def test_suite_from_the_configuration_table(spark, tmp_path, people):
    people.write.option("header", "true").csv(str(tmp_path / "raw"))
    store = stores.config_store(spark, str(tmp_path / "config"))
    rows = [
        ("good", True, '{"age": {"min": 0, "max": 120}}'), ("broken", True, "{not json"),
        ("off", False, None), ("unset", None, None),
    ]
    frame = spark.createDataFrame(rows, "mapping_id string, on boolean, numeric_range_checks string")
    stores.add_mappings(store, frame.select(
        "mapping_id", "numeric_range_checks",
        F.lit(str(tmp_path)).alias("source_bucket"), F.lit("raw/*.csv").alias("source_file_path"),
        F.lit("csv").alias("source_file_format"), F.lit("ds").alias("target_dataset"),
        F.lit("people").alias("target_table"),
        F.array(F.lit("numeric_range")).alias("enabled_test_ids"),
        F.coalesce("on", F.lit(False)).alias("is_active")))
    run = run_config(spark, store.read(), T.from_frames({"ds.people": people}))
    assert outcome(run) == {"row_count_match": ("PASS", 0), "numeric_range": ("FAIL", 1)}
    errors = {r.mapping_id: r.error for r in run.mappings.collect()}
    assert errors["good"] is None and errors["broken"] and len(errors) == 2
    broken = specs.broken_settings(store.read()).collect()
    assert [tuple(r) for r in broken] == [("broken", "numeric_range_checks")]


def test_how_to_read_the_source_comes_from_the_configuration(spark, tmp_path, people):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text('id,t\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text("id,t\n1,x\n")
    rows = [("glob", None, None, True), ("regex", None, "regex", True), ("one", "first", "regex", True)]
    frame = spark.createDataFrame(
        rows, "mapping_id string, source_files string, source_pattern_mode string,"
        " source_multiline boolean")
    store = stores.config_store(spark, str(tmp_path / "config"))
    stores.add_mappings(store, frame.select(
        "*", F.lit(str(tmp_path)).alias("source_bucket"), F.lit("*.csv").alias("source_file_path"),
        F.lit("csv").alias("source_file_format"), F.lit("ds").alias("target_dataset"),
        F.lit("people").alias("target_table"), F.lit(False).alias("auto_suggest")))
    run = run_config(spark, store.read(), T.from_frames({"ds.people": people}))
    counts = {r.mapping_id: r.file_row_count for r in run.mappings.collect()}
    assert counts == {"glob": 1, "regex": 2, "one": 1}


def test_decoded_settings_of_every_kind(spark):
    row = dict(
        mapping_id="m",
        numeric_range_checks=json.dumps({"age": {"min": 18, "max": 120}}),
        date_range_checks=json.dumps({"d": {"min_date": "2024-01-01", "max_date": "2024-12-31"}}),
        foreign_key_checks=json.dumps({"c": {"table": "a.b", "column": "id"}}),
        pattern_checks=r'{"email": "^[^@]+@[^@]+\\.[^@]+$"}',
    )
    got = {r.test_id: r for r in specs.check_specs(config(spark, row)).collect()}
    assert len(got) == 4
    assert (got["numeric_range"].min, got["numeric_range"].max) == (18.0, 120.0)
    assert got["date_range"].max_date == "2024-12-31"
    assert (got["referential_integrity"].ref_table, got["referential_integrity"].ref_column) == (
        "a.b", "id")
    assert got["pattern_validation"].pattern == r"^[^@]+@[^@]+\.[^@]+$"


def test_settings_that_are_already_maps(spark):
    df = config(spark, {"mapping_id": "m"}).withColumn(
        "pattern_checks", F.create_map(F.lit("c"), F.lit("x")))
    assert [r.pattern for r in specs.check_specs(df).collect()] == ["x"]


def test_planned_checks_frame_agrees_with_the_runner(spark, people, tables):
    rows = [
        {"mapping_id": "a", "enabled_test_ids": ["numeric_range", "zzz", "row_count_match",
                                                 "no_nulls_required", "numeric_range"],
         "required_columns": ["email"], "numeric_range_checks": '{"age": {"min": 0, "max": 1}}'},
        {"mapping_id": "b", "primary_key_columns": ["id"], "required_columns": []},
        {"mapping_id": "c", "enabled_test_ids": []},
    ]
    planned = specs.planned_checks(config(spark, *rows)).orderBy("mapping_id", "position").collect()
    got = {}
    for r in planned:
        got.setdefault(r.mapping_id, []).append((r.position, r.test_id))
    assert got == {
        "a": [(0, "row_count_match"), (1, "numeric_range"), (4, "no_nulls_required"),
              (5, "numeric_range")],
        "b": [(0, "row_count_match"), (3, "no_duplicates_pk")],
        "c": [(0, "row_count_match")],
    }
    a = Mapping("a", people, "people", required_columns=("email",),
                numeric_range_checks={"age": {"min": 0, "max": 1}},
                enabled_test_ids=tuple(rows[0]["enabled_test_ids"]))
    run = run_mapping(spark, a, tables).results.orderBy("position").collect()
    assert [(r.position, r.test_id) for r in run] == got["a"]


def test_custom_checks(spark, people):
    people.createOrReplaceTempView("tc_people")
    checks = [
        ("old", "SELECT * FROM tc_people WHERE age > 120;"),
        ("fine", "WITH x AS (SELECT 1 AS a) SELECT * FROM x WHERE a > 1 -- none"),
        ("bad", "SELECT nope FROM tc_people"),
        ("late", "SELECT * FROM tc_people WHERE CAST(email AS INT) > 0"),
        ("drop", "DROP VIEW tc_people"),
        ("two", "SELECT 1; DROP VIEW tc_people"),
        ("insert", "INSERT INTO tc_people VALUES (1)"),
        ("blank", "  ;"),
        ("none", None),
    ]
    df = spark.createDataFrame(checks, "test_name string, sql_query string").withColumns(
        {c: F.lit("x") for c in ("test_id", "test_category", "severity", "description")})
    got = {r.test_name: (r.status, r.rows_affected) for r in run_custom_checks(spark, df).collect()}
    assert got == {"old": ("FAIL", 1), "fine": ("PASS", 0), "bad": ("ERROR", 0),
                   "late": ("ERROR", 0), "drop": ("ERROR", 0), "two": ("ERROR", 0),
                   "insert": ("ERROR", 0)}
    assert spark.table("tc_people").count() == 5


def test_run_status_rules(spark):
    counts = spark.createDataFrame(
        [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0), (1, 0, 5, 1)],
        "failed int, errors int, total_issues int, mapping_errors int")

    def statuses(mode, legacy):
        return [r.run_status for r in rollups.run_status(counts, mode, legacy).collect()]

    assert statuses("config", True) == ["AT_RISK", "PASS", "PASS", "PASS", "AT_RISK"]
    assert statuses("single", True) == ["FAIL", "FAIL", "PASS", "PASS", "FAIL"]
    assert statuses("schema", True) == ["PASS", "PASS", "PASS", "PASS", "AT_RISK"]
    assert statuses("config", False) == ["AT_RISK", "PASS", "ERROR", "PASS", "ERROR"]
    with pytest.raises(ValueError):
        rollups.run_status(counts, "other")


def test_summary_counts_failed_mappings_and_suggestions(spark, people, tables):
    run = run_suite(spark, [mapping(people), Mapping("gone", people, "nowhere")], tables)
    suggestions = spark.range(3)
    got = rollups.suite_summary(run.results, run.mappings, suggestions).first().asDict()
    assert got == {"total_mappings": 2, "total_tests": 7, "passed": 2, "failed": 5, "errors": 0,
                   "total_suggestions": 3}
    assert rollups.check_summary(run.results).first().asDict() == {
        "total_tests": 7, "passed": 2, "failed": 5, "errors": 0}


def test_summary_of_stored_details(spark):
    listed = [{"status": "PASS"}, {"status": "FAIL"}, {"status": "ERROR"}, {"status": "PASS"}]
    rows = [
        ("a", json.dumps({"results": listed})),
        ("b", json.dumps({"predefined_results": listed[:1], "results": listed})),
        ("c", json.dumps({"summary": {"total_tests": 9, "passed": 8, "failed": 1, "errors": 0},
                          "results": listed})),
        ("d", json.dumps({"results": []})), ("e", "{}"), ("f", None),
    ]
    df = spark.createDataFrame(rows, "execution_id string, details string")
    got = {r.execution_id: tuple(r)[1:] for r in rollups.summary_from_details(df).collect()}
    none = (None, None, None, None)
    assert got == {"a": (4, 2, 1, 1), "b": (1, 1, 0, 0), "c": (9, 8, 1, 0), "d": (0, 0, 0, 0),
                   "e": none, "f": none}


def test_other_counts_what_neither_passed_nor_failed(spark):
    runs = spark.createDataFrame([(10, 6, 1), (3, None, 1), (None, None, None)],
                                 "total_tests int, passed_tests int, failed_tests int")
    assert [r.other for r in rollups.with_other(runs).collect()] == [3, 2, 0]


def test_results_go_to_the_history(spark, tmp_path, people, tables):
    run = run_mapping(spark, mapping(people), tables)
    store = stores.check_history_store(spark, str(tmp_path / "history"))
    stores.log_checks(store, rollups.history_rows(run.results, run.mappings, "run-1"))
    saved = store.read().collect()
    assert len(saved) == 7
    assert {(r.execution_id, r.source_row_count, r.target_row_count) for r in saved} == {
        ("run-1", 5, 5)}
    assert all(r.executed_at is not None and r.execution_time_ms is not None for r in saved)


def test_row_checks_share_one_scan(spark, people, tables):
    m = mapping(people, enabled_test_ids=("no_nulls_required", "numeric_range",
                                          "pattern_validation"))
    plans = runner.plan_mapping(runner.LoadedMapping(spark, m, people, tables))
    assert all(p.predicate for p in plans)
    metrics = runner.metrics(None, people, plans)
    assert metrics.count() == 4


def test_a_mapping_is_planned_without_a_session_from_schemas(people, tables):
    m = mapping(
        people,
        primary_key_columns=("id",),
        pattern_checks={"email": "@"},
        numeric_range_checks={"email": {"min": 1, "max": 2}},
        enabled_test_ids=("no_duplicates_pk", "numeric_range", "pattern_validation", "outlier_detection", "gone"),
    )
    schema = runner.TableSchema(people.schema)
    with_session = runner.plan_mapping(runner.LoadedMapping(people.sparkSession, m, people, tables))
    plans = runner.plan_mapping(runner.LoadedMapping(None, m, schema, lambda name: schema))
    told = [(p.position, p.check.test_id, p.predicate, p.sql_query, p.error) for p in plans]
    assert told == [(p.position, p.check.test_id, p.predicate, p.sql_query, p.error) for p in with_session]
    assert len(plans) >= 3 and all(p.violations is None for p in plans) and any(p.error for p in plans)


def test_a_mapping_suggests_further_checks(spark, people, tables):
    run = run_mapping(spark, mapping(people, auto_suggest=True), tables)
    found = {(r.column_name, r.test_category) for r in run.suggestions.collect()}
    assert found == {("id", "completeness"), ("email", "business")}
    assert run_mapping(spark, mapping(people), tables).suggestions.count() == 0
    summary = rollups.suite_summary(run.results, run.mappings, run.suggestions).first()
    assert summary.total_suggestions == run.suggestions.count()


def test_suggestions_learn_from_source_files(spark, tmp_path, people):
    people.where("id < 3").select("age", "id", "email").write.option("header", "true").csv(
        str(tmp_path / "src"))
    run = run_single_file(spark, SourceFiles(str(tmp_path), "src/*.csv"), "ds.people",
                          T.from_frames({"ds.people": people}), ["email"])
    found = {(r.column_name, r.test_category): r.estimated_failures
             for r in run.suggestions.collect()}
    assert found[("age", "completeness")] == 1 and found[("email", "quality")] == 1
    assert run.mappings.first().target == "ds.people"


def test_a_run_becomes_one_row_of_the_history(spark, tmp_path, people, tables):
    run = run_suite(spark, [mapping(people), Mapping("gone", people, "nowhere")], tables)
    store = stores.run_history_store(spark, str(tmp_path / "runs"))
    for legacy in (True, False):
        stores.log_runs(store, rollups.run_record(
            run.results, run.mappings, "config", "config.loads", "many", "p", legacy_rules=legacy))
    saved = store.read().collect()
    assert sorted(r.status for r in saved) == ["AT_RISK", "ERROR"]
    assert {(r.total_tests, r.passed_tests, r.failed_tests) for r in saved} == {(7, 2, 5)}
    assert len({r.execution_id for r in saved}) == 2
    details = json.loads(saved[0].details)
    assert details["summary"]["total_mappings"] == 2
    again = rollups.summary_from_details(store.read()).collect()
    assert {tuple(r)[1:] for r in again} == {(7, 2, 5, 0)}
    found = {r.mapping_id: r for r in rollups.run_details(
        run.results, run.mappings, "e", run.suggestions).collect()}
    assert len(json.loads(found["m"].predefined_results)) == 7 and found["m"].error is None
    assert json.loads(found["gone"].predefined_results) == [] and found["gone"].error
    with pytest.raises(ValueError, match="schema_record"):
        rollups.run_record(run.results, run.mappings, "schema", "a", "b")


def test_a_row_without_a_bucket_is_its_own_error(spark, people, tables, tmp_path):
    people.write.option("header", "true").csv(str(tmp_path / "p"))
    rows = [("good", str(tmp_path), "p/*.csv"), ("bad", None, "p/*.csv"), ("none", str(tmp_path), None)]
    config = spark.createDataFrame(rows, "mapping_id string, source_bucket string, source_file_path string")
    config = config.selectExpr(
        "*", "'csv' AS source_file_format", "'people' AS target_table", "true AS is_active",
        "cast(NULL AS string) AS target_dataset", "false AS auto_suggest")
    found = {r.mapping_id: r for r in run_config(spark, config, tables).mappings.collect()}
    assert found["good"].error is None and found["good"].file_row_count == 5
    assert "needs a root" in found["bad"].error and "needs a path" in found["none"].error


def test_a_format_without_its_reader_is_the_mapping_s_error(spark, people, tables):
    run = run_mapping(spark, mapping(SourceFiles("/tmp", "no-such-file", "avro")), tables)
    assert run.results.count() == 0 and run.mappings.first().error
