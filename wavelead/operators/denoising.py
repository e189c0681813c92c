"""Cleaning of leads, in array rows and in the long layout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelead.functions.columns import universal_threshold, whole_div
from wavelead.functions.wavelet import (
    LEVEL,
    MAD_SCALE,
    TAPS,
    WAVELET,
    denoise,
    denoise_with,
    finest_detail,
    from_bits,
    list_values,
)
from wavelead.operators.layout import CHUNK, LEAD, arrays_to_samples, samples_to_arrays
from wavelead.storage import materialize

Step = Callable[[Column], Column]


def clean_leads(leads: DataFrame, *steps: Step) -> DataFrame:
    """Replace ``signal`` by the result of the cleaning steps, the wavelet denoiser by default.

    A step takes and returns an array column, so further methods chain freely.
    """
    signal = F.col("signal")
    for step in steps or (denoise,):
        signal = step(signal)
    return leads.withColumn("signal", signal)


def denoise_samples(
    samples: DataFrame,
    by: list[str] = LEAD,
    chunk: int = CHUNK,
    halo: int = 1024,
    wavelet: str = WAVELET,
    level: int = LEVEL,
) -> DataFrame:
    """:func:`denoise_chunks` for samples ``(by, i, value)`` in the long layout."""
    chunks = samples_to_arrays(samples, chunk, by=by).select(*by, "start", "signal")
    return arrays_to_samples(denoise_chunks(chunks, by, chunk, halo, wavelet, level), by, start="start")


def denoise_chunks(
    chunks: DataFrame,
    by: list[str] = LEAD,
    chunk: int = CHUNK,
    halo: int = 1024,
    wavelet: str = WAVELET,
    level: int = LEVEL,
) -> DataFrame:
    """Denoise leads of any length that are kept in rows ``(by, start, signal)`` of ``chunk`` samples.

    ``start`` is a multiple of ``chunk``; only the last row of a lead may be
    shorter. A lead of one row is denoised in one go. A longer one never comes
    together in one task: its rows get the ``halo`` values next to them from
    their neighbours, which is all that is exchanged, its noise level is the
    exact median over all of them (:func:`chunk_medians`), and each row is then
    transformed with its neighbouring values, so that its own part is what the
    transform of the whole lead would give.
    """
    align = 2**level
    reach = 2 * (TAPS - 1) * (align - 1)
    if chunk % align or halo % align or not reach <= halo <= chunk:
        raise ValueError(f"chunk and halo must be multiples of {align}, halo {reach} to chunk")

    chunks = materialize(chunks.select(*by, F.col("start").cast("long").alias("start"), "signal"), "chunks")
    edge = F.slice("signal", F.greatest(F.size("signal") - halo + 1, F.lit(1)), halo)
    left = chunks.select(*by, (F.col("start") + chunk).alias("start"), edge.alias("left"))
    right = chunks.where("start > 0").select(
        *by, (F.col("start") - chunk).alias("start"), F.slice("signal", 1, halo).alias("right")
    )
    none = F.array().cast("array<double>")
    joined = chunks.join(left, [*by, "start"], "left").join(right, [*by, "start"], "left")
    alone = F.col("left").isNull() & F.col("right").isNull()
    short = joined.where(alone).select(*by, "start", denoise(F.col("signal"), wavelet, level).alias("signal"))

    # The detail values of a row itself, not of its neighbours; the last row of
    # a lead also holds those of the right boundary.
    details = finest_detail(F.col("context"))
    own = F.slice(
        F.col("details"),
        whole_div(F.col("before"), 2).cast("int") + 1,
        F.when(F.col("is_last"), F.size("details")).otherwise(F.lit(chunk // 2)),
    )
    parts = materialize(
        joined.where(~alone)
        .select(
            *by,
            "start",
            F.size("signal").alias("n"),
            F.coalesce(F.size("left"), F.lit(0)).alias("before"),
            F.col("right").isNull().alias("is_last"),
            F.concat(F.coalesce("left", none), "signal", F.coalesce("right", none)).alias("context"),
        )
        .withColumn("details", details)
        .select(*by, "start", "n", "before", "context", own.alias("details")),
        "denoise-parts",
    )
    limits = _chunk_thresholds(parts, by, chunk)
    long = (
        parts.drop("details")
        .join(limits, [*by, "start"])
        .withColumn("clean", denoise_with(F.col("context"), F.col("threshold"), wavelet, level))
        .select(*by, "start", F.slice("clean", F.col("before") + 1, F.col("n")).alias("signal"))
    )
    return short.unionByName(long)


def _chunk_thresholds(parts: DataFrame, by: list[str], chunk: int) -> DataFrame:
    """Threshold of every lead that spans several rows, one row per row of the lead."""
    has_nan = F.exists("context", lambda v: v.isNull() | F.isnan(v))
    leads = parts.groupBy(*by).agg(F.max(F.col("start") + F.col("n")).alias("n"), F.max(has_nan).alias("has_nan"))
    sigma = chunk_medians(parts, by, "details", leads.select(*by, _starts(F.col("n"), chunk).alias("starts")))
    return leads.join(sigma, by).select(
        *by,
        F.explode(_starts(F.col("n"), chunk)).alias("start"),
        F.when(F.col("has_nan"), F.lit(float("nan")))
        .otherwise(universal_threshold(F.col("median") / MAD_SCALE, F.col("n")))
        .alias("threshold"),
    )


def _starts(n: Column, chunk: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), n - 1, F.lit(chunk).cast("long"))


# Bits that are still open after each pass of a selection by bit patterns.
OPEN_BITS = (44, 22, 0)


def chunk_medians(parts: DataFrame, by: list[str], values: str, rows: DataFrame) -> DataFrame:
    """Exact median of the magnitudes in all arrays ``values`` of a ``by`` group: ``(by, median)``.

    A selection instead of a sort: magnitudes are ordered like their bit
    patterns. The first pass counts how often each of the upper 20 bits occurs,
    which tells the one or two patterns that the middle ranks have; the next
    counts 22 further bits of the values under those, the last the rest. Only
    counts are shuffled, no more than four million of a group in any pass, and
    the passes serve all groups at once. ``rows`` has the ``starts`` of a group's
    rows; the ranks sought go to each of them, so that no task gets all rows of
    a large group.
    """
    found = None
    for pass_, open_ in enumerate(OPEN_BITS):
        source = parts.select(*by, "start", values)
        if found is not None:
            sought = found.join(rows, by).select(
                *by, F.explode("starts").alias("start"), "low", "high"
            )
            source = source.join(sought, [*by, "start"])
        counts = (
            _count_patterns(source, by, values, open_, OPEN_BITS[pass_ - 1] if pass_ else None)
            .groupBy(*by, "pattern")
            .agg(F.sum("n").alias("n"))
        )
        group = Window.partitionBy(*by)
        earlier = group.orderBy("pattern").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        if found is None:
            total = F.sum("n").over(group)
            counts = counts.withColumn("first", whole_div(total - 1, 2)).withColumn("second", whole_div(total, 2))
        else:
            counts = counts.join(found.select(*by, "first", "second"), by)

        def holds(rank: str) -> Column:
            return (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("n"))

        # The two ranks are neighbours, so nothing lies between the two patterns.
        found = materialize(
            counts.groupBy(*by)
            .agg(
                F.max(F.when(holds("first"), F.col("pattern"))).alias("low"),
                F.max(F.when(holds("second"), F.col("pattern"))).alias("high"),
                F.max(F.when(holds("first"), F.col("before"))).alias("skipped"),
                F.max("first").alias("first"),
                F.max("second").alias("second"),
            )
            .withColumn("first", F.col("first") - F.col("skipped"))
            .withColumn("second", F.col("second") - F.col("skipped"))
            .drop("skipped"),
            "median-ranks",
        )
    return found.select(*by, ((from_bits(F.col("low")) + from_bits(F.col("high"))) / 2).alias("median"))


def _count_patterns(source: DataFrame, by: list[str], values: str, open_: int, known: int | None) -> DataFrame:
    """How often each pattern above the ``open_`` bits occurs in a row, under the ``known`` ones if given."""
    schema = source.select(*by).schema.add("pattern", "long").add("n", "long")
    names = schema.names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts, lengths = list_values(batch.column(values))
            row, patterns, counts = [], [], []
            if known is not None:
                low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
            for k, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist())):
                bits = np.abs(flat[a : a + max(n, 0)]).view(np.int64)
                if known is not None:
                    upper = bits >> known
                    bits = bits[(upper == low[k]) | (upper == high[k])]
                pattern, count_ = np.unique(bits >> open_, return_counts=True)
                row.append(np.full(len(pattern), k))
                patterns.append(pattern)
                counts.append(count_)
            if row:
                row = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(row) for c in by),
                        pa.array(np.concatenate(patterns), pa.int64()),
                        pa.array(np.concatenate(counts), pa.int64()),
                    ],
                    names=names,
                )

    return source.mapInArrow(count, schema)
