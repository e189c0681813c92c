"""Metadata, recordings and what is known about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelead.functions.columns import binarize_label, count_windows, window_size

# Columns of the metadata file.
KEY = "patient_id"
DIAGNOSIS = "brugada"

# Size of the complete collection and the least that is accepted.
EXPECTED_RECORDINGS = 363
MINIMUM_RECORDINGS = 300


def label_metadata(meta: DataFrame, diagnosis: str = DIAGNOSIS) -> DataFrame:
    """Metadata with the binary ``label``."""
    return meta.withColumn("label", binarize_label(F.col(diagnosis)))


def label_sets(meta: DataFrame) -> DataFrame:
    """One row per patient with the array of its labels, at most the two there are.

    Metadata that lists a patient twice gives every label once.
    """
    return meta.groupBy(KEY).agg(F.sort_array(F.collect_set("label")).alias("labels"))


def with_metadata(meta: DataFrame, recordings: DataFrame, key: str = KEY) -> DataFrame:
    """Recordings with the columns of their metadata row.

    No broadcast is forced: metadata has one row per recording and grows with
    them, so Spark's own size check picks the join.
    """
    return recordings.join(meta, key)


def missing_recordings(
    meta: DataFrame, recordings: DataFrame, key: str = KEY, strict: bool = False
) -> DataFrame:
    """Metadata rows without a recording; with ``strict`` their presence is an error."""
    present = recordings.select(key).distinct()
    missing = meta.join(present, key, "left_anti")
    if strict:
        first = missing.select(key).head(1)
        if first:
            raise FileNotFoundError(f"no recording for {key}={first[0][0]}")
    return missing


def completeness(
    recordings: DataFrame,
    key: str = KEY,
    expected: int = EXPECTED_RECORDINGS,
    minimum: int = MINIMUM_RECORDINGS,
) -> DataFrame:
    """One row: number of recordings, the expected number, and ``ok`` or ``warn``."""
    return recordings.agg(F.count_distinct(key).alias("n")).select(
        "n",
        F.lit(expected).alias("expected"),
        F.when(F.col("n") < minimum, "warn").otherwise("ok").alias("status"),
    )


def cohort_summary(meta: DataFrame, diagnosis: str = DIAGNOSIS) -> DataFrame:
    """One row: all rows, cases (1 or 2) and normals (0) by the raw diagnosis."""
    return meta.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col(diagnosis).isin(1, 2)).alias("n_cases"),
        F.count_if(F.col(diagnosis) == 0).alias("n_normal"),
    )


def recording_profile(leads: DataFrame, duration: float = 3) -> DataFrame:
    """Per recording: shape, sampling rate, number of full windows, missing samples, lead names.

    Windows are computed from the length, so a recording that is too short
    shows up with 0 of them.
    """
    is_missing = F.filter("signal", lambda v: v.isNull() | F.isnan(v))
    return (
        leads.groupBy(KEY)
        .agg(
            F.max(F.size("signal")).alias("n_samples"),
            F.count(F.lit(1)).alias("n_leads"),
            F.max("fs").alias("fs"),
            F.max(count_windows(F.col("signal"), window_size(F.col("fs"), duration))).alias(
                "n_segments"
            ),
            F.sum(F.size(is_missing)).alias("n_missing"),
            # A set of the lead names: copies of a lead do not make it larger.
            F.sort_array(F.collect_set(F.struct("lead_idx", "lead"))).alias("names"),
        )
        .withColumn("leads", F.col("names.lead"))
        .drop("names")
    )


def head_profile(
    meta: DataFrame, leads: DataFrame, n: int = 5, order: str = KEY, duration: float = 3
) -> DataFrame:
    """The first ``n`` metadata rows by ``order``, with the profile of their recordings."""
    head = meta.orderBy(order).limit(n)
    wanted = leads.join(head.select(KEY), KEY, "left_semi")
    return head.join(recording_profile(wanted, duration), KEY, "left")


def correct_labels(
    meta: DataFrame, corrections: DataFrame, diagnosis: str = DIAGNOSIS
) -> DataFrame:
    """Apply a table of corrected diagnoses; ``changed`` marks the rows that differ.

    One correction per patient is expected; of several the highest counts.
    """
    fixes = corrections.groupBy(KEY).agg(F.max(diagnosis).alias("_fixed"))
    old, fixed = F.col(diagnosis), F.coalesce("_fixed", diagnosis)
    return (
        meta.join(fixes, KEY, "left")
        .withColumn("changed", ~fixed.eqNullSafe(old))
        .withColumn(diagnosis, fixed)
        .drop("_fixed")
    )
