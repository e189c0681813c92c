"""Long layout (one row per sample) and array layout (one row per lead), and the way between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelead.functions.columns import whole_div
from wavelead.operators.ranking import row_index

LEAD = ["patient_id", "lead_idx"]
# Longest stretch of a lead kept in one array row.
CHUNK = 65_536


def index_samples(samples: DataFrame, order: list[str], by: list[str] = LEAD) -> DataFrame:
    """Number the samples of every lead from 0 in ``order`` (time first, then a tie-breaker)."""
    return row_index(samples, by, order, "i")


def arrays_to_samples(
    leads: DataFrame, by: list[str] = LEAD, signal: str = "signal", start: str | None = None
) -> DataFrame:
    """One row per sample: the key columns, ``i`` and ``value``.

    ``start`` names the column with the position of the first array element
    for leads that are split into chunks.
    """
    first = F.col(start) if start else F.lit(0)
    return leads.select(
        *by, first.cast("long").alias("_first"), F.posexplode(signal).alias("_pos", "value")
    ).select(*by, (F.col("_first") + F.col("_pos")).alias("i"), "value")


def samples_to_arrays(
    samples: DataFrame, chunk: int = CHUNK, halo: int = 0, by: list[str] = LEAD
) -> DataFrame:
    """Array rows from samples ``(by, i, value)`` whose ``i`` runs from 0 without gaps.

    A lead of up to ``chunk`` samples becomes one row with ``chunk_idx`` 0; a
    longer one becomes as many rows as it takes, so no group is larger than
    ``chunk`` whatever the length of the lead. With ``halo`` every row also
    holds up to that many neighbouring samples on either side. ``start`` is
    the position of the first element of ``signal``.
    """
    i = F.col("i")
    if halo:
        target = F.explode(
            F.sequence(
                whole_div(F.greatest(i - halo, F.lit(0)), chunk), whole_div(i + halo, chunk)
            )
        )
    else:
        target = whole_div(i, chunk)
    pairs = F.sort_array(F.collect_list(F.struct("i", "value")))
    return (
        samples.select(*by, "i", "value", target.alias("chunk_idx"))
        .groupBy(*by, "chunk_idx")
        .agg(pairs.alias("pairs"), F.max("i").alias("last"))
        # A stretch that only caught the halo of its left neighbour is no chunk.
        .where(F.col("last") >= F.col("chunk_idx") * chunk)
        .select(
            *by,
            "chunk_idx",
            F.get("pairs", 0)["i"].alias("start"),
            F.col("pairs.value").alias("signal"),
        )
    )
