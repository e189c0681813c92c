"""Fusion of scores and analysis of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: weight of the first of two fused models.
FUSION_WEIGHT = 0.65


def late_fusion(
    first: DataFrame,
    second: DataFrame,
    weight: float = FUSION_WEIGHT,
    key: str = "id",
    score: str = "p",
) -> DataFrame:
    """``weight * first + (1 - weight) * second`` for every id that both models scored."""
    a = first.select(key, F.col(score).alias("_a"))
    b = second.select(key, F.col(score).alias("_b"))
    fused = weight * F.col("_a") + (1 - weight) * F.col("_b")
    return a.join(b, key).select(key, fused.alias(score))


def _positive(column: str) -> Column:
    """A case is what the binary label calls one: anything above 0. Null and NaN are unknown."""
    value = F.col(column).cast("double")
    return F.when(value.isNull() | F.isnan(value), None).otherwise(value > 0)


def confusion(rows: DataFrame, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: confusion counts, sensitivity, specificity and accuracy.

    ``n_unknown`` counts the rows whose truth or prediction is not known; they
    are in none of the other figures.
    """
    actual, called = _positive(truth), _positive(prediction)
    counts = rows.agg(
        F.count_if(actual & called).alias("tp"),
        F.count_if(actual & ~called).alias("fn"),
        F.count_if(~actual & called).alias("fp"),
        F.count_if(~actual & ~called).alias("tn"),
        F.count_if(actual.isNull() | called.isNull()).alias("n_unknown"),
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return counts.select(
        "*",
        F.try_divide(tp, tp + fn).alias("sensitivity"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(tp + tn, tp + fn + fp + tn).alias("accuracy"),
    )


def misses(
    rows: DataFrame, key: str, truth: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """The rows that :func:`confusion` does not count as right, with the kind of error."""
    actual, called = _positive(truth), _positive(prediction)
    error = (
        F.when(actual.isNull() | called.isNull(), "unknown")
        .when(actual & ~called, "missed")
        .when(~actual & called, "false alarm")
    )
    return rows.select(key, truth, prediction, error.alias("error")).where("error IS NOT NULL")
