"""Exact position of a row within its group, for groups of any size."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelead.storage import materialize


def row_index(
    df: DataFrame, by: list[str], order: list[str], name: str = "i", count: str | None = None
) -> DataFrame:
    """Add the zero-based position of every row in its ``by`` group, sorted by ``order``.

    ``count`` names a further column for the size of the group.

    ``order`` has to be unique within a group. The rows are range-partitioned on
    ``by + order``, which splits a huge group over many tasks, written once to
    the shared folder, and each stretch of a group is numbered from the number
    of rows in the stretches before it. The plan is the same for every size.
    """
    keys = [*by, *order]
    # The upper bits of the generated id are the range partition, the lower
    # 33 bits the position in it. Both must stay the same in all that follows,
    # hence the written table.
    placed = materialize(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
        "row-index",
    ).withColumn("_part", F.shiftright("_place", 33))

    renamed = [F.col(c).alias(f"_by_{c}") for c in by]
    # One row per group and range partition: bounded for every group.
    stretches = placed.groupBy(*renamed, F.col("_part").alias("_run")).agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    offsets = _within_groups(stretches) if by else _over_all(stretches)
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by],
        F.col("_part") == F.col("_run"),
    )
    return placed.join(offsets, same).select(
        *[F.col(c) for c in df.columns],
        (F.col("_place") - F.col("_first") + F.col("_offset")).alias(name),
        *([F.col("_size").alias(count)] if count else []),
    )


def _within_groups(stretches: DataFrame) -> DataFrame:
    names = [c for c in stretches.columns if c.startswith("_by_")]
    group = Window.partitionBy(*names)
    earlier = group.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    return (
        stretches.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_size", F.sum("_n").over(group))
        .drop("_n")
    )


def _over_all(stretches: DataFrame) -> DataFrame:
    """Without groups there is one stretch per range partition: few enough to add up here."""
    rows = stretches.orderBy("_run").collect()
    ends = list(accumulate((r["_n"] for r in rows), initial=0))
    table = [(r["_run"], r["_first"], start, ends[-1]) for r, start in zip(rows, ends)]
    return stretches.sparkSession.createDataFrame(
        table, "_run long, _first long, _offset long, _size long"
    )
