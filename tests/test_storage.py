import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wavelead.storage import CLEANUP, materialize, settle, shared_folder


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(context, setting=None):
    conf = SimpleNamespace(get=lambda name, default=None: setting or default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_the_folder_of_the_session_is_used():
    cluster = Context("spark://host:7077")
    assert shared_folder(session(cluster, "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(session(Context("yarn", "hdfs:///set"))) == "hdfs:///set"


def test_a_temporary_folder_only_locally():
    with pytest.raises(RuntimeError):
        shared_folder(session(Context("yarn")))
    local = Context("local[2]")
    assert shared_folder(session(local)) == local.folder


def test_tables_read_back_as_they_were(spark):
    df = spark.range(10).selectExpr("id", "cast(id % 3 as int) as fold", "array(id) as x")
    back = materialize(df, "test", ("fold",))
    assert dict(back.dtypes) == dict(df.dtypes)
    rows = back.select("id", "fold", "x").orderBy("id").collect()
    assert rows == df.orderBy("id").collect()


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in name}


def left_of(spark, before):
    """Shuffle files that were not there before; executors remove theirs when they hear of it."""
    until = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    return left


def test_steps_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    held = []

    def build():
        sums = spark.range(5000).groupBy((F.col("id") % 500).alias("k")).agg(F.sum("id").alias("s"))
        # What still refers to a query doesn't keep its files.
        held.append(sums)
        table = materialize(sums, "sums")
        assert not left_of(spark, before)
        held.append(table.join(sums, "k").groupBy("k").agg(F.count("*").alias("n")))
        return held[-1]

    back = settle(spark, "test", build)
    assert not left_of(spark, before)
    assert spark.conf.get(CLEANUP) == setting
    assert back.where("n = 1").count() == 500
    # The same frame can be run again.
    assert held[0].count() == 500
