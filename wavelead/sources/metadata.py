"""The metadata table."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavelead.operators.records import DIAGNOSIS, KEY

CORRUPT = "_corrupt_record"


def read_metadata(
    spark: SparkSession, path: str, extra: str = "", corrupt: str | None = None
) -> DataFrame:
    """Metadata CSV with header; the patient number is a LONG, the diagnosis a DOUBLE.

    ``path`` is a file or a folder of files. All other columns are passed on, as
    strings unless ``extra`` gives their type as DDL. Columns are taken by name,
    whatever their order in a file: the files are read once for each distinct
    header, and a column that a file lacks is null there. Fields that do not fit
    their type become null. With ``corrupt`` the text of such a line goes to a
    column of that name. The diagnosis is a DOUBLE because a file with gaps may
    spell it ``1.0``, which an INT column would turn into null.
    """
    ddl = f"{KEY} long, {DIAGNOSIS} double"
    schema = T.StructType.fromDDL(f"{ddl}, {extra}" if extra else ddl)
    known = {f.name: f for f in schema}
    parts = []
    for header, files in _headers(spark, path).items():
        absent = set(known) - set(header)
        if absent:
            raise ValueError(f"metadata has no column {sorted(absent)}")
        fields = [known.get(c, T.StructField(c, T.StringType())) for c in header]
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        # The header of a file has to be the one its columns are named by.
        reader = reader.option("enforceSchema", False)
        if corrupt:
            fields.append(T.StructField(corrupt, T.StringType()))
            reader = reader.option("columnNameOfCorruptRecord", corrupt)
        parts.append(reader.schema(T.StructType(fields)).csv(files))
    if not parts:
        raise ValueError(f"no metadata in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files below ``path`` by the columns that their first line names.

    One job gathers the first lines of all files; after that there is one look at
    a file for each distinct line. Files without a line have no columns and no rows.
    """
    lines = (
        spark.read.text(path)
        # A file's first lines are in its first block, and lines of a block are read in order.
        .where((F.col("_metadata.file_block_start") == 0) & (F.trim("value") != ""))
        .select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("at"))
    )
    first = lines.groupBy("file_path").agg(F.min_by("value", "at").alias("line"))
    # Metadata columns spell a path as a URI.
    name = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    groups = first.groupBy("line").agg(F.sort_array(F.collect_list(name)).alias("files"))
    found = defaultdict(list)
    for row in groups.collect():  # a row per distinct header
        columns = spark.read.option("header", True).csv(row["files"][0]).columns
        found[tuple(columns)] += row["files"]
    return found


def split_metadata(meta: DataFrame, corrupt: str = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the others with the reason, of metadata read with ``corrupt``.

    An empty diagnosis is usable. Text that is no number is not an empty cell:
    such a row is rejected rather than taken for a normal one.
    """
    # Spark looks at the columns it is asked for only, so both of them are part
    # of the reason: else a query of the patients alone would pass a bad diagnosis.
    reason = (
        F.when(F.col(corrupt).isNotNull(), "line not understood")
        .when(F.col(KEY).isNull(), "patient number is missing")
        .when(F.abs(DIAGNOSIS) == float("inf"), "diagnosis is not finite")
    )
    marked = meta.withColumn("reason", reason)
    good = marked.where("reason IS NULL").drop("reason", corrupt)
    bad = marked.where("reason IS NOT NULL").select(KEY, DIAGNOSIS, F.col(corrupt).alias("line"), "reason")
    return good, bad
