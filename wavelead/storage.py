"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# The folder that tables go to at the moment, if they are to be removed together.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)
# Whether Spark removes the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        # local-cluster has executors of its own.
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wavelead-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several branches of a plan must see the very same rows: the
    written table survives the loss of executors and cuts the lineage.
    """
    path = new_path(df.sparkSession, name)
    # Tables that stay for others only leave it to Spark when their shuffle files go.
    with without_shuffles(df.sparkSession) if _scratch.get() else nullcontext():
        df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this package has written, by the file system that it is on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside leave no shuffle files when they end.

    For tables that are written, as nothing reads the shuffles of such a query later.
    """
    before = spark.conf.get(CLEANUP, "false")
    if before == "true":
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished queries go that :func:`without_shuffles` was not around.

    Spark removes them once the driver's JVM has collected what referred to them,
    which may be long after.
    """
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go to a folder of their own, which is removed at the end."""
    folder = new_path(spark, "scratch")
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        remove(spark, folder)


def settle(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` materialized; the tables that it writes on the way are removed once the result is written.

    The result is read back from its own table, so nothing that can be lost
    later needs them again.
    """
    path = new_path(spark, name)
    with scratch(spark):
        df = build()
        schema = df.schema
        with without_shuffles(spark):
            df.write.parquet(path)
        del df
    release(spark)
    return spark.read.schema(schema).parquet(path)
