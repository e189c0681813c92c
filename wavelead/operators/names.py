"""Segment identity in file names: ``<patient>_<label>_seg<number>.npy`` in folder ``<patient>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segment_name(patient_id: Column, label: Column, seg_idx: Column, suffix: str = "") -> Column:
    return F.format_string(f"%d_%d_seg%d{suffix}", patient_id, label, seg_idx)


def parse_names(
    files: DataFrame, name: str = "name", folder: str = "folder", suffix: str = ""
) -> DataFrame:
    """Add ``label``, ``group`` and ``reason`` to rows of file names.

    Names without the suffix are left out. ``reason`` is null where both keys
    could be read; a row that cannot be read is kept, so nothing is lost.
    """
    return (
        files.where(F.col(name).endswith(suffix))
        .withColumn("label", F.get(F.split(name, "_"), F.lit(1)).try_cast("int"))
        .withColumn("group", F.col(folder).try_cast("long"))
        .withColumn(
            "reason",
            F.when(F.col("label").isNull(), "label is not a number").when(
                F.col("group").isNull(), "patient is not a number"
            ),
        )
    )


def readable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def unreadable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull())
