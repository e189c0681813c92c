"""From recordings and metadata to the finished data set.

As a job::

    spark-submit --py-files wavelead.zip wavelead/plans/prepare.py \\
        --metadata META.csv --recordings FOLDER --output FOLDER
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelead.functions.columns import count_windows, window_size
from wavelead.functions.wavelet import denoise, denoise_all
from wavelead.operators.dataset import (
    SHAPE,
    Observed,
    collect_recordings,
    dataset_rows,
    shape_problem,
)
from wavelead.operators.denoising import Step, clean_leads
from wavelead.operators.records import (
    cohort_summary,
    completeness,
    label_metadata,
    label_sets,
    missing_recordings,
)
from wavelead.operators.segment import segment_leads, segment_recordings, unsegmentable
from wavelead.sources.metadata import CORRUPT, read_metadata, split_metadata
from wavelead.sources.recordings import lead_rows, read_headers, recording_rejects, whole_recordings
from wavelead.sources.signals import Reader, locate_recordings, read_bytes, read_whole
from wavelead.sources.tables import write_segments


# Segments are floats, so the last cleaning step may as well give floats.
STEPS: tuple[Step, ...] = (partial(denoise, dtype="float"),)


def preprocess(leads: DataFrame, duration: float = 3, steps: tuple[Step, ...] = STEPS) -> DataFrame:
    """Clean whole leads, then cut them: the noise level needs the full length."""
    return segment_leads(clean_leads(leads, *steps), duration=duration)


def segment_matrices(
    leads: DataFrame,
    duration: float = 3,
    n_leads: int = SHAPE[1],
    steps: tuple[Step, ...] = STEPS,
) -> DataFrame:
    """Windows of whole recordings from labelled leads, one matrix each.

    Leads are cleaned on the partitions they are read in. One shuffle then
    brings the leads of a recording together, as floats and before they are
    cut, so it moves one row per lead instead of one per lead and window.
    """
    recordings = collect_recordings(clean_leads(leads, *steps), n_leads)
    return segment_recordings(recordings, n_leads, duration=duration)


def build_dataset(
    leads: DataFrame, duration: float = 3, shape: tuple[int, int] = SHAPE
) -> DataFrame:
    """Data set rows from labelled leads."""
    return dataset_rows(segment_matrices(leads, duration, shape[1]), shape)


def cut_recordings(
    whole: DataFrame,
    duration: float = 3,
    n_leads: int = SHAPE[1],
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Windows of cleaned recordings from rows that hold all their leads and ``labels``.

    A patient listed under both labels gives segments for either.
    """
    label = F.explode_outer("labels") if keep else F.explode("labels")
    cleaned = (
        whole.withColumn("signals", denoise_all(F.col("signals"), dtype="float"))
        .withColumn("n_surplus", F.greatest(F.size("signals") - n_leads, F.lit(0)))
        .withColumn("label", label)
    )
    return segment_recordings(cleaned, n_leads, duration=duration, keep=keep)


def matrices_of_decoded(
    decoded: DataFrame, duration: float = 3, n_leads: int = SHAPE[1]
) -> DataFrame:
    """The windows of labelled recordings, ready for the check of their shape.

    A recording kept in one file arrives with all its leads in one row and is
    cleaned and cut without any shuffle; only recordings spread over several
    files are brought together first, and then treated alike.
    """
    whole = whole_recordings(decoded.where(F.size("labels") > 0))
    return cut_recordings(whole, duration, n_leads)


PROFILE = ("fs", "profile")


def judged_windows(
    decoded: DataFrame, duration: float = 3, shape: tuple[int, int] = SHAPE
) -> DataFrame:
    """All windows with what becomes of them in ``kind``, and the profile of their recording.

    ``kind`` is ``dataset``, ``reject`` (with a ``reason``; its matrix is not
    kept), ``unlabelled`` (no metadata), or ``none`` for the one row of a
    recording without windows. Everything is told from one pass over the
    signals, so they are decoded, cleaned and cut once.
    """
    windows = count_windows(F.get("signals", 0), window_size(F.col("fs"), duration))
    length = F.transform("signals", lambda lead: F.size(lead))
    missing = F.transform("signals", lambda lead: F.size(F.filter(lead, lambda v: v.isNull() | F.isnan(v))))
    profile = F.struct(
        F.array_max(length).alias("n_samples"),
        F.size("signals").alias("n_leads"),
        windows.alias("n_segments"),
        F.aggregate(missing, F.lit(0), lambda a, b: a + b).alias("n_missing"),
        "lead_idx",
        F.col("lead").alias("leads"),
    )
    whole = whole_recordings(decoded).withColumn("profile", profile)
    cut = cut_recordings(whole, duration, shape[1], PROFILE)
    reason = F.when(F.col("seg_idx").isNotNull(), shape_problem(shape))
    kind = (
        F.when(F.col("seg_idx").isNull(), "none")
        .when(F.col("label").isNull(), "unlabelled")
        .when(reason.isNull(), "dataset")
        .otherwise("reject")
    )
    return cut.select(
        F.col("patient_id").alias("group"),
        "label",
        "seg_idx",
        F.col("max_samples").cast("int").alias("n_samples"),
        F.col("n_leads").cast("int").alias("n_leads"),
        F.when(kind == "dataset", F.col("x")).alias("x"),
        "fs",
        "profile",
        reason.alias("reason"),
        kind.alias("kind"),
    )


def prepare(
    spark: SparkSession,
    metadata: str,
    recordings: str,
    output: str,
    duration: float = 3,
    shape: tuple[int, int] = SHAPE,
    strict: bool = True,
    keep_segments: bool = False,
    read: Reader = read_bytes,
    equal_copies: bool = False,
) -> DataFrame:
    """Write the data set, its rejects and the profile below ``output``; return the report.

    The signals are read once, where their headers point, into ``windows``,
    partitioned by ``kind``: the data set is ``windows/kind=dataset``, the other
    tables are small ones drawn from it. What headers and metadata tell is
    checked before any signal is read. ``read`` opens the signal files. With
    ``equal_copies`` recordings of a patient that are the same byte for byte
    count once, for which those of patients with several are read twice.

    With ``strict`` a patient without a recording or an empty data set is an
    error. With ``keep_segments`` the segments of single leads are written too,
    in a pass of their own.
    """

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{output}/{name}")

    usable, unusable = split_metadata(read_metadata(spark, metadata, corrupt=CORRUPT))
    meta = label_metadata(usable)
    write(unusable, "metadata_rejects")
    write(cohort_summary(meta), "cohort")
    headers = read_headers(spark, recordings).cache()
    located = None
    try:
        found = headers.where(F.col("patient_id").isNotNull())
        write(missing_recordings(meta, found, strict=strict), "missing_recordings")
        write(found.select("patient_id", "folder", "record").join(meta, "patient_id", "left_anti"), "unlabelled_recordings")
        write(completeness(found), "completeness")

        located = locate_recordings(
            spark, recordings, labels=label_sets(meta), headers=headers, equal_copies=equal_copies, read=read
        ).cache()
        write(recording_rejects(located), "recording_rejects")
        decoded = read_whole(located, read)
        windows = judged_windows(decoded, duration, shape)
        # The order that the write by kind asks for, so that the matrices are sorted once.
        watched = Observed("kind = 'dataset'")
        ordered = watched.watch(windows).sortWithinPartitions("kind", "group", "seg_idx")
        ordered.write.mode("overwrite").partitionBy(
            "kind"
        ).parquet(f"{output}/windows")
        if keep_segments:
            segments = preprocess(lead_rows(decoded), duration).withColumn("label", F.explode("labels"))
            write_segments(segments.drop("fs", "labels"), f"{output}/segments")
    finally:
        headers.unpersist()
        if located is not None:
            located.unpersist()

    table = spark.read.schema(windows.schema).parquet(f"{output}/windows")
    rejected = table.where("kind = 'reject'")
    write(rejected.select(F.col("group").alias("patient_id"), "label", "seg_idx", "reason"), "shape_rejects")
    # One row per recording, from columns beside the matrices.
    each = table.select("group", "fs", "profile").dropDuplicates(["group"])
    profile = each.select(
        F.col("group").alias("patient_id"),
        *[f"profile.{c}" for c in ("n_samples", "n_leads")],
        "fs",
        *[f"profile.{c}" for c in ("n_segments", "n_missing", "leads")],
    )
    write(profile, "profile")
    leads = each.select(F.col("group").alias("patient_id"), F.explode("profile.lead_idx").alias("lead_idx"), "fs")
    write(unsegmentable(leads, duration), "rate_rejects")
    return watched.report(table.where("kind = 'dataset'"), shape, strict)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--metadata", required=True)
    parser.add_argument("--recordings", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--duration", type=float, default=3)
    parser.add_argument("--samples", type=int, default=SHAPE[0])
    parser.add_argument("--leads", type=int, default=SHAPE[1])
    parser.add_argument("--lenient", action="store_true")
    parser.add_argument("--keep-segments", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("wavelead").getOrCreate()
    prepare(
        spark,
        args.metadata,
        args.recordings,
        args.output,
        args.duration,
        (args.samples, args.leads),
        not args.lenient,
        args.keep_segments,
    ).show()


if __name__ == "__main__":
    main()
