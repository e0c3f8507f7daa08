from types import SimpleNamespace

import pytest

from tablecheck.session import local_frame, shared_dir


def session(**settings):
    settings = {k.replace("_", "."): v for k, v in settings.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)))


def test_the_cluster_s_folder_is_used():
    where = shared_dir(session(spark_checkpoint_dir="hdfs://ns/shared/", spark_master="yarn"), "x")
    assert where.startswith("hdfs://ns/shared/tablecheck/x-")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(spark_master="yarn"), "x")
    assert "tablecheck/x-" in shared_dir(session(spark_master="local[2]"), "x")


def test_the_running_session_knows_its_master(spark):
    assert spark.conf.get("spark.master").startswith("local")


def test_a_few_rows_take_one_task(spark):
    assert local_frame(spark, [(i,) for i in range(20)], "i int").rdd.getNumPartitions() == 1
    assert local_frame(spark, [], "i int").count() == 0
