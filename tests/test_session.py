"""The shared folder, scratch tables, and helpers that travel with the job."""

from types import SimpleNamespace

import pytest
from pyspark import cloudpickle

from fieldpulse.operators.isolation import grow_tree
from fieldpulse.session import materialize, scratch_path, shared_folder
from fieldpulse.sources.tables import spread


def fake(setting, master, checkpoint=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint, setCheckpointDir=lambda d: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting), sparkContext=context)


def test_the_cluster_names_the_folder():
    assert shared_folder(fake("s3a://b/shared/", "yarn")) == "s3a://b/shared"
    assert shared_folder(fake(None, "yarn", "hdfs://x/cp")) == "hdfs://x/cp"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared_folder(fake(None, "spark://host:7077"))
    assert shared_folder(fake(None, "local[2]"))


def test_scratch_paths_never_repeat(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_materialize_ends_the_lineage(spark):
    df = materialize(spark.range(5).selectExpr("id * 2 AS id"), "t")
    assert sorted(r["id"] for r in df.collect()) == [0, 2, 4, 6, 8]
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_only_touches_scans_with_few_tasks(spark):
    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=64)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(many) is many


def test_task_helpers_need_no_installed_package():
    assert b"grow_tree" in cloudpickle.dumps(grow_tree) and len(cloudpickle.dumps(grow_tree)) > 500
