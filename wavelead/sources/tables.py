"""Parquet tables for segments and for the finished data set."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_SCHEMA = (
    "patient_id long, label int, seg_idx int, lead_idx int, lead string, samples array<float>"
)
DATASET_SCHEMA = (
    "group long, label int, seg_idx int, n_samples int, n_leads int, x array<array<float>>"
)


def _write(df: DataFrame, path: str, order: list[str]) -> None:
    # Sorting inside the partitions costs no shuffle and gives the row groups
    # narrow key ranges, so that a lookup of some patients skips the others.
    df.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_segments(segments: DataFrame, path: str) -> None:
    """Replace the segment table at ``path``."""
    _write(segments, path, ["patient_id", "seg_idx"])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments from all folders below ``path``; files of other kinds are left out."""
    return (
        spark.read.schema(SEGMENT_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(path)
    )


def write_dataset(dataset: DataFrame, path: str) -> None:
    """Replace the data set at ``path``: matrix, label and group of a segment in one row."""
    _write(dataset, path, ["group", "seg_idx"])


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET_SCHEMA).parquet(path)


# -- Tables that are replaced by key, in versions -----------------------------
#
# data/version=V    the rows that a run has written
# keys/version=V    the keys that the run stands for
# manifest/n=N      the versions that count, oldest first
#
# A manifest is one small file, and Spark shows it only once its job is
# committed. Until then readers see the manifest before it and the versions that
# that one names, which nothing changes or removes.


def _live(spark: SparkSession, root: str) -> tuple[int, list[str]]:
    """Number of the latest manifest and the versions that it names; -1 if there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return -1, []
    # A folder without committed files has no rows.
    rows = spark.read.schema("place int, version string, n int").parquet(f"{root}/manifest")
    last = rows.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("place", "version"))).alias("v"))
    row = last.orderBy(F.desc("n")).first()
    return (row["n"], [v["version"] for v in row["v"]]) if row else (-1, [])


def publish(
    rows: DataFrame,
    root: str,
    key: str,
    keys: DataFrame | None = None,
    check: Callable[[DataFrame], object] | None = None,
    replace_all: bool = False,
) -> None:
    """Write ``rows`` as a new version of the table at ``root``.

    They replace all earlier rows of the keys that ``keys`` holds (those of
    ``rows`` unless given: a key that has no rows any more has to be among
    them, and rows of other keys don't count). With ``replace_all`` they replace the table. ``check`` gets the
    written rows; if it raises, or anything else fails, readers go on to see the
    table as it was. One writer at a time.
    """
    spark = rows.sparkSession
    number, live = _live(spark, root)
    version = f"{number + 1:06d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/data/version={version}")
    written = spark.read.schema(rows.schema).parquet(f"{root}/data/version={version}")
    of_run = (written if keys is None else keys).select(F.col(key).alias("key")).distinct()
    of_run.write.parquet(f"{root}/keys/version={version}")
    if check is not None:
        check(written)
    versions = [version] if replace_all else [*live, version]
    manifest = spark.createDataFrame(list(enumerate(versions)), "place int, version string")
    manifest.coalesce(1).write.parquet(f"{root}/manifest/n={number + 1}")


def read_published(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The table at ``root``: of every key the rows of the latest version that stands for it.

    A table of one version is read as it is. Otherwise its rows are joined with
    the keys, a row each, which Spark broadcasts while they are small.
    """
    _, live = _live(spark, root)
    if not live:
        raise FileNotFoundError(f"nothing published at {root}")
    tables = [spark.read.parquet(f"{root}/data/version={v}") for v in live]
    if len(live) == 1:
        return tables[0]
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [t.withColumn("_place", F.lit(n)) for n, t in enumerate(tables)],
    )
    keys = reduce(
        DataFrame.unionByName,
        [spark.read.parquet(f"{root}/keys/version={v}").withColumn("latest", F.lit(n)) for n, v in enumerate(live)],
    )
    latest = keys.groupBy("key").agg(F.max("latest").alias("latest"))
    same = F.col(key).eqNullSafe(F.col("key")) & (F.col("_place") == F.col("latest"))
    return rows.join(latest, same, "left_semi").drop("_place")


def compact(spark: SparkSession, root: str, key: str) -> None:
    """Write the table as a single version, so that it is read without a join again."""
    publish(read_published(spark, root, key), root, key, replace_all=True)
