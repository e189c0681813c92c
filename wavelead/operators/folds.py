"""Grouped, stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelead.operators.ranking import row_index


def group_folds(
    rows: DataFrame,
    k: int = 5,
    group: str = "group",
    label: str = "label",
) -> DataFrame:
    """One row per group with its label (the highest of its rows) and its ``fold``.

    Within a label the groups are dealt out in turn, so every fold gets its
    share of both labels.
    """
    groups = rows.groupBy(group).agg(F.max(label).alias(label))
    ranked = row_index(groups, [label], [group], "_rank")
    return ranked.select(group, label, (F.col("_rank") % k).cast("int").alias("fold"))


def assign_folds(
    rows: DataFrame,
    k: int = 5,
    group: str = "group",
    label: str = "label",
) -> DataFrame:
    """Add ``fold``; all rows of a group share one."""
    folds = group_folds(rows, k, group, label).select(group, "fold")
    return rows.join(folds, group)
