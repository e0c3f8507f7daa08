import time

from pyspark.sql import functions as F

from tablecheck import Mapping, run_suite
from tablecheck.operators.rowchecks import counts_while_written, fused_counts
from tablecheck.plans.limits import jobs_of


def mapping(name, source, target):
    return Mapping(name, source, target, primary_key_columns=("k",), required_columns=("k",),
                   enabled_test_ids=("no_nulls_required",))


def test_a_stuck_mapping_has_an_error_and_the_others_finish(spark):
    good = spark.range(100).selectExpr("id AS k")
    # hashing so many rows takes hours; its two tasks leave room for the others
    stuck = spark.range(0, 10**13, 1, 2).selectExpr("CASE WHEN hash(id, id + 1) = 17 THEN NULL ELSE id END AS k")
    frames = {"good": good, "stuck": stuck, "also_good": good}
    mappings = [mapping(t, good, t) for t in frames]
    started = time.monotonic()
    run = run_suite(spark, mappings, frames.__getitem__, parallel=3, time_limit=20)
    assert time.monotonic() - started < 90
    errors = {r.mapping_id: r.error for r in run.mappings.collect()}
    assert errors == {"good": None, "also_good": None, "stuck": "stopped after 20 seconds"}
    assert {r.mapping_id for r in run.results.where("status = 'PASS'").collect()} == {"good", "also_good"}
    # nothing of the stopped mapping holds the executors
    assert spark.range(1000).where("id % 7 = 0").count() == 143


def test_no_limit_and_the_threads_settings_come_back(spark):
    context = spark.sparkContext
    context.setLocalProperty("spark.scheduler.pool", "mine")
    try:
        with jobs_of(spark, "m", 60) as limit:
            assert context.getLocalProperty("spark.scheduler.pool") == "m"
            assert len(context.getJobTags()) == 1
            assert spark.range(5).count() == 5
        assert not limit.over
        assert context.getLocalProperty("spark.scheduler.pool") == "mine"
        assert not context.getJobTags()
    finally:
        context.setLocalProperty("spark.scheduler.pool", None)


def test_counts_while_written_take_one_job(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 7 END AS v").repartition(5)
    predicates = {"nulls": "v IS NULL", "big": "v > 4", "none": "id < 0"}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("written", "")
    try:
        got = counts_while_written(df, predicates, lambda rows: rows.write.parquet(f"{tmp_path}/t"))
        jobs = len(tracker.getJobIdsForGroup("written"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2, "the shuffle and the write"
    stored = spark.read.parquet(f"{tmp_path}/t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, fused_counts(stored, predicates).collect()))
    assert got.where(F.col("metric") == "rows").first().value == 1000


def test_counts_of_an_empty_load(spark, tmp_path):
    empty = spark.range(0)
    got = counts_while_written(empty, {"x": "id > 1"}, lambda rows: rows.write.parquet(f"{tmp_path}/t"))
    assert sorted(map(tuple, got.collect())) == [("rows", 0), ("x", 0)]
