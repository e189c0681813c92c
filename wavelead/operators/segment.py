"""Tumbling count windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelead.functions.columns import (
    count_windows,
    to_float,
    whole_div,
    window,
    window_numbers,
    window_size,
)
from wavelead.operators.layout import LEAD


def segment_leads(
    leads: DataFrame, fs: Column | float | None = None, duration: float = 3
) -> DataFrame:
    """One row per full window of every lead, numbered by ``seg_idx`` from 0.

    ``fs`` defaults to the column of that name. The window is a projection and
    a generator, so there is no shuffle. A lead shorter than one window gives
    no row; see :func:`unsegmentable` for leads whose rate allows no window.
    """
    size = window_size(F.col("fs") if fs is None else fs, duration)
    kept = [c for c in leads.columns if c != "signal"]
    n = count_windows(F.col("signal"), size)
    part = window(F.col("signal"), F.col("seg_idx"), F.col("_size"))
    # The second generator gives one row; what is computed from the samples
    # later stays above it, so that a window is cut once.
    return leads.select(
        *kept, "signal", size.alias("_size"), F.explode(window_numbers(n)).alias("seg_idx")
    ).select(*kept, "seg_idx", F.explode(F.array(part)).alias("samples"))


def segment_recordings(
    recordings: DataFrame,
    n_leads: int,
    fs: Column | float | None = None,
    duration: float = 3,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per window of a recording, all leads together in the matrix ``x``.

    Takes rows with all leads of a recording in ``signals``; no shuffle either.
    ``x`` holds those of the first ``n_leads`` leads that fill the window; the
    column ``n_leads`` also counts the surplus, leads beyond and repeated rows.
    With columns to ``keep``, a recording without windows has one row, whose
    ``seg_idx`` is null.
    """
    size = window_size(F.col("fs") if fs is None else fs, duration)
    most = F.array_max(F.transform("signals", lambda lead: count_windows(lead, size)))
    parts = F.array(
        *[
            window(F.get("signals", F.lit(j)), F.col("seg_idx"), F.col("_size"))
            for j in range(n_leads)
        ]
    )
    length = F.transform("x", lambda lead: F.size(lead))
    generate = F.explode_outer if keep else F.explode
    return (
        recordings.select(
            "patient_id",
            "label",
            *keep,
            "n_surplus",
            "signals",
            size.alias("_size"),
            generate(window_numbers(most)).alias("seg_idx"),
        )
        # As in segment_leads, a generator of one row.
        .select("*", F.explode(F.array(parts)).alias("_parts"))
        .withColumn("x", F.filter("_parts", lambda part: F.size(part) == F.col("_size")))
        .select(
            "patient_id",
            "label",
            *keep,
            "seg_idx",
            (F.size("x") + F.col("n_surplus")).alias("n_leads"),
            F.array_min(length).alias("min_samples"),
            F.array_max(length).alias("max_samples"),
            "x",
        )
    )


def unsegmentable(leads: DataFrame, duration: float = 3) -> DataFrame:
    """Leads whose sampling rate is missing or gives a window of no samples."""
    return leads.where(window_size(F.col("fs"), duration).isNull()).select(
        *LEAD, "fs", F.lit("no window fits the sampling rate").alias("reason")
    )


def segment_samples(samples: DataFrame, size: int, by: list[str] = LEAD) -> DataFrame:
    """The same windows from the long layout ``(by, i, value)``, for leads of any length.

    Grouping is by lead and window, so no group exceeds ``size`` samples.
    """
    if size < 1:
        raise ValueError(f"window of {size} samples")
    pairs = F.sort_array(F.collect_list(F.struct("i", "value")))
    return (
        samples.groupBy(*by, whole_div(F.col("i"), size).cast("int").alias("seg_idx"))
        .agg(pairs.alias("pairs"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == size)
        .select(*by, "seg_idx", to_float(F.col("pairs.value")).alias("samples"))
    )
