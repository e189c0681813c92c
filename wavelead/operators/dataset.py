"""Segments of single leads joined into training rows, with the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Samples and leads of a valid segment.
SHAPE = (300, 12)

SEGMENT = ["patient_id", "label", "seg_idx"]


def collate(segments: DataFrame, n_leads: int = SHAPE[1]) -> DataFrame:
    """One row per segment with its shape and the lead-major matrix ``x``.

    Every lead has its own aggregate, so the state of a group is ``n_leads``
    arrays at most, however many rows claim to belong to it.
    """
    lead = [
        F.any_value(F.when(F.col("lead_idx") == j, F.col("samples")), True).alias(f"_lead{j}")
        for j in range(n_leads)
    ]
    length = F.size("samples")
    return (
        segments.groupBy(*SEGMENT)
        .agg(
            F.count(F.lit(1)).alias("n_leads"),
            F.min(length).alias("min_samples"),
            F.max(length).alias("max_samples"),
            *lead,
        )
        .withColumn("x", F.array(*[f"_lead{j}" for j in range(n_leads)]))
        .drop(*[f"_lead{j}" for j in range(n_leads)])
    )


def collect_recordings(leads: DataFrame, n_leads: int = SHAPE[1]) -> DataFrame:
    """One row per recording with all leads in ``signals``, as floats.

    The state of a group is bounded in the same way as in :func:`collate`.
    ``n_surplus`` counts the rows beyond one per lead.
    """
    names = [f"_lead{j}" for j in range(n_leads)]
    present = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return (
        leads.withColumn("signal", F.col("signal").cast("array<float>"))
        .groupBy("patient_id", "label", "fs")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            *[
                F.any_value(F.when(F.col("lead_idx") == j, F.col("signal")), True).alias(c)
                for j, c in enumerate(names)
            ],
        )
        .select(
            "patient_id",
            "label",
            "fs",
            F.array(*names).alias("signals"),
            (F.col("n_rows") - present).cast("int").alias("n_surplus"),
        )
    )


def shape_problem(shape: tuple[int, int]) -> Column:
    """Why a collated segment has not exactly the wanted shape; null if it has."""
    n_samples, n_leads = shape
    return (
        F.when(F.col("min_samples") != F.col("max_samples"), "leads differ in length")
        .when(
            (F.col("max_samples") != n_samples) | (F.col("n_leads") != n_leads),
            F.format_string("shape (%d, %d)", F.col("max_samples"), F.col("n_leads")),
        )
        .when(
            (F.size("x") != n_leads) | F.exists("x", lambda lead: lead.isNull()),
            "a lead is missing",
        )
    )


def dataset_rows(collated: DataFrame, shape: tuple[int, int] = SHAPE) -> DataFrame:
    """The segments of exactly the wanted shape, as rows of the data set."""
    return collated.where(shape_problem(shape).isNull()).select(
        F.col("patient_id").alias("group"),
        "label",
        "seg_idx",
        F.col("max_samples").alias("n_samples"),
        F.col("n_leads").cast("int").alias("n_leads"),
        "x",
    )


def shape_rejects(collated: DataFrame, shape: tuple[int, int] = SHAPE) -> DataFrame:
    """The other segments, with the reason."""
    reason = shape_problem(shape)
    return collated.where(reason.isNotNull()).select(*SEGMENT, reason.alias("reason"))


REPORT = (
    "n_rows long, n_labels long, n_group_rows long, n_groups long, n_segments long, n_positive long, "
    "n_negative long, min_samples int, max_samples int, min_leads int, max_leads int"
)


def _shape_metrics(condition: str = "true") -> list[Column]:
    """What a report says about the rows for which ``condition`` holds, as aggregates."""
    only = F.expr(condition)
    inner = F.transform("x", lambda lead: F.size(lead))
    return [
        F.count_if(only).alias("n_rows"),
        F.count(F.when(only, F.col("label"))).alias("n_labels"),
        F.count(F.when(only, F.col("group"))).alias("n_group_rows"),
        F.count_if(only & (F.col("label") == 1)).alias("n_positive"),
        F.count_if(only & (F.col("label") == 0)).alias("n_negative"),
        F.min(F.when(only, F.array_min(inner))).alias("min_samples"),
        F.max(F.when(only, F.array_max(inner))).alias("max_samples"),
        F.min(F.when(only, F.size("x"))).alias("min_leads"),
        F.max(F.when(only, F.size("x"))).alias("max_leads"),
    ]


def _over_groups(segments: DataFrame) -> DataFrame:
    """Totals from one row per distinct segment; groups are counted on the way."""
    names = [c for c in segments.columns if c.startswith(("n_", "min_", "max_"))]

    def merged() -> list[Column]:
        how = {"n": F.sum, "min": F.min, "max": F.max}
        return [how[c.split("_")[0]](c).alias(c) for c in names]

    each = segments.groupBy("group").agg(F.count(F.lit(1)).alias("segments"), *merged())
    return each.agg(
        F.count("group").alias("n_groups"),
        F.coalesce(F.sum("segments"), F.lit(0)).alias("n_segments"),
        *[F.coalesce(c, F.lit(0)).alias(n) if n.startswith("n_") else c for c, n in zip(merged(), names)],
    )


def _judged(report: DataFrame, shape: tuple[int, int], strict: bool) -> DataFrame:
    report = report.select(*[field.split()[0] for field in REPORT.split(", ")]).withColumn(
        "ok",
        (F.col("n_rows") > 0)
        & (F.col("n_labels") == F.col("n_rows"))
        & (F.col("n_group_rows") == F.col("n_rows"))
        # No segment twice.
        & (F.col("n_segments") == F.col("n_rows"))
        & (F.col("min_samples") == shape[0])
        & (F.col("max_samples") == shape[0])
        & (F.col("min_leads") == shape[1])
        & (F.col("max_leads") == shape[1]),
    )
    if strict:
        row = report.first()
        if not row["ok"]:
            raise ValueError(f"data set violates its shape {shape}: {row.asDict()}")
    return report


SEGMENT_KEY = ["group", "label", "seg_idx"]


def dataset_report(
    dataset: DataFrame, shape: tuple[int, int] = SHAPE, strict: bool = False
) -> DataFrame:
    """One row about the whole data set; with ``strict`` an empty or ill-shaped one is an error.

    One pass: rows are summed up by segment and group, which counts the distinct ones.
    """
    return _judged(_over_groups(dataset.groupBy(*SEGMENT_KEY).agg(*_shape_metrics())), shape, strict)


class Observed:
    """Counts and shapes of a data set, taken while it is written.

    ``watch`` returns the rows to be written, of which those count for which
    ``condition`` holds. After the write ``report`` needs no second look at the
    matrices, only at the key columns of what was written.
    """

    def __init__(self, condition: str = "true"):
        self.observation, self.condition = Observation("data set"), condition

    def watch(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self.observation, *_shape_metrics(self.condition))

    def report(self, written: DataFrame, shape: tuple[int, int] = SHAPE, strict: bool = False) -> DataFrame:
        """As :func:`dataset_report`, for the table that the watched rows were written to."""
        keys = _over_groups(written.select(*SEGMENT_KEY).distinct()).first()
        seen = {**self.observation.get, **keys.asDict()}
        row = tuple(seen[field.split()[0]] for field in REPORT.split(", "))
        return _judged(written.sparkSession.createDataFrame([row], REPORT), shape, strict)
