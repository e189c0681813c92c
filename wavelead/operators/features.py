"""Summary features of leads and recordings.

The feature list is this package's own: location, spread, shape and the energy
of every wavelet band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelead.functions.wavelet import LEVEL, blocks, decompose, list_values
from wavelead.operators.layout import LEAD

BANDS = ["a4", "d4", "d3", "d2", "d1"]
FEATURES = [
    "mean",
    "std",
    "min",
    "max",
    "median",
    "rms",
    "peak_to_peak",
    "zero_crossings",
    *[f"energy_{band}" for band in BANDS],
]


def _summaries(x: np.ndarray) -> np.ndarray:
    """One row per feature, in the order of ``FEATURES``, one column per row of the block."""
    low, high = x.min(axis=1), x.max(axis=1)
    crossings = (x[:, 1:] * x[:, :-1] < 0).sum(axis=1)
    return np.vstack(
        [
            x.mean(axis=1),
            x.std(axis=1),
            low,
            high,
            np.median(x, axis=1),
            np.sqrt((x**2).mean(axis=1)),
            high - low,
            crossings,
            *[(band**2).sum(axis=1) for band in decompose(x, LEVEL)],
        ]
    )


def summarize(signal: Column) -> Column:
    """Struct of the features of a lead."""

    @F.arrow_udf(", ".join(f"{name} double" for name in FEATURES))
    def run(column: pa.Array) -> pa.Array:
        values, starts, lengths = list_values(column)
        table = np.full((len(FEATURES), len(lengths)), np.nan)
        for n, rows in blocks(lengths):
            table[:, rows] = _summaries(values[starts[rows, None] + np.arange(n)])
        return pa.StructArray.from_arrays([pa.array(row) for row in table], names=FEATURES)

    return run(signal)


def lead_features(leads: DataFrame, by: list[str] = LEAD) -> DataFrame:
    """One row per lead; standard deviation is that of the population."""
    return leads.select(*by, summarize(F.col("signal")).alias("f"), F.size("signal").alias("n")).select(
        *by, "n", "f.*"
    )


def record_features(per_lead: DataFrame, n_leads: int = 12) -> DataFrame:
    """One row per recording with a column per lead and feature, ``l<lead>_<feature>``."""
    features = F.struct(*FEATURES)
    by_lead = [
        F.any_value(F.when(F.col("lead_idx") == j, features), True).alias(f"l{j}")
        for j in range(n_leads)
    ]
    return (
        per_lead.groupBy("patient_id")
        .agg(*by_lead)
        .select(
            "patient_id",
            *[
                F.col(f"l{j}.{name}").alias(f"l{j}_{name}")
                for j in range(n_leads)
                for name in FEATURES
            ],
        )
    )
