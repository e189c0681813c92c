"""The bijection that deals values out, and what fitted models fulfil."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelead.operators.models import FACTOR, SHIFT, fit_gaps, permute_column, round_keys, shuffled


def plain(x, n, seed):
    half = max(1, -(-(max(n - 1, 1).bit_length()) // 2))
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for key in round_keys(seed):
            left, right = right, left ^ (((right * FACTOR + key) >> SHIFT) & ((1 << half) - 1))
        x = left << half | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 65, 1000, 4097])
def test_every_number_is_given_once(spark, n):
    rows = spark.range(n).select("id", shuffled(F.col("id"), n).alias("to"), shuffled(F.col("id"), n, 7).alias("other"))
    found = rows.orderBy("id").collect()
    assert [r["to"] for r in found] == [plain(k, n, 42) for k in range(n)]
    assert sorted(r["to"] for r in found) == sorted(r["other"] for r in found) == list(range(n))
    if n >= 65:
        assert sum(r["to"] == r["id"] for r in found) < n / 4
        assert sum(r["to"] == r["other"] for r in found) < n / 4


def test_large_numbers(spark):
    n = 10**12 + 39
    rows = spark.range(n - 500, n).select("id", shuffled(F.col("id"), n).alias("to")).collect()
    assert all(r["to"] == plain(r["id"], n, 42) for r in rows) and len({r["to"] for r in rows}) == 500


def test_a_column_is_dealt_out_over_the_other_rows(spark):
    rows = spark.range(300).select((F.col("id") * 3).alias("id"), F.col("id").alias("value"), F.lit("x").alias("kept"))
    found = permute_column(rows, "value").orderBy("id").collect()
    assert sorted(r["value"] for r in found) == list(range(300))
    assert {plain(r["value"], 300, 42): r["id"] for r in found} == {k: 3 * k for k in range(300)}
    assert permute_column(rows.limit(0), "value").count() == 0
    assert [tuple(r) for r in permute_column(rows.limit(1), "value").collect()] == [(0, 0, "x")]


def test_gaps_tell_a_fit_from_a_poor_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + rng.normal(size=400) > 0.3).astype(int)
    rows = spark.createDataFrame(
        [(int(y[k]), k % 3, float(x[k, 0]), float(x[k, 1] * 1e6), 0.125) for k in range(400)],
        "label int, fold int, a double, b double, c double",
    )
    good = fit_gaps(rows, ["a", "b", "c"]).collect()
    assert sorted(r["fold"] for r in good) == [0, 1, 2]
    for r in good:
        train = np.arange(400) % 3 != r["fold"]
        assert r["n_train"] == train.sum() and abs(r["rate"] - y[train].mean()) < 1e-9
        assert abs(r["mean_score"] - r["rate"]) < 1e-4 and r["max_gradient"] < 1e-4
