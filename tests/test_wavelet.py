import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelead.functions import columns as C
from wavelead.functions.wavelet import (
    DEC_HI,
    DEC_LO,
    REC_LO,
    decompose,
    denoise,
    denoise_all,
    denoise_block,
    recompose,
    shrink,
    wavedec,
    waverec,
)


def plain_analysis(x, taps):
    """The definition, term by term."""
    n = len(x)
    out = []
    for k in range((n + 17) // 2):
        total = 0.0
        for j in range(18):
            m = (2 * k + 1 - j) % (2 * n)
            total += taps[j] * x[m if m < n else 2 * n - 1 - m]
        out.append(total)
    return np.array(out)


def plain_denoise(x):
    bands = decompose(np.array([x]))
    t = np.median(np.abs(bands[-1][0])) / 0.6745 * np.sqrt(2 * np.log(len(x)))
    return recompose([bands[0], *(shrink(b, t) for b in bands[1:])], len(x))[0]


def test_filters_sum_to_root_two():
    assert np.isclose(DEC_LO.sum(), np.sqrt(2))
    assert np.isclose(REC_LO.sum(), np.sqrt(2))
    assert np.isclose(DEC_HI.sum(), 0.0)


@pytest.mark.parametrize(
    "n, lengths",
    [
        (64, [19, 19, 22, 28, 40]),
        (300, [34, 34, 52, 87, 158]),
        (1200, [90, 90, 164, 312, 608]),
    ],
)
def test_band_lengths(n, lengths):
    assert [b.shape[1] for b in decompose(np.ones((1, n)))] == lengths


@pytest.mark.parametrize("n", [1, 2, 7, 18, 64, 299])
def test_analysis_follows_the_definition(n):
    x = np.random.default_rng(n).normal(size=n)
    low, high = decompose(np.array([x]), 1)
    assert np.allclose(low[0], plain_analysis(x, DEC_LO), atol=1e-13)
    assert np.allclose(high[0], plain_analysis(x, DEC_HI), atol=1e-13)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 6), st.integers(0, 2**31))
def test_reconstruction_is_perfect(n, level, seed):
    x = np.random.default_rng(seed).normal(size=(2, n))
    assert np.allclose(recompose(decompose(x, level), n), x, atol=1e-9)


def test_zero_threshold_changes_nothing():
    x = np.random.default_rng(0).normal(size=(3, 301))
    assert np.allclose(denoise_block(x, threshold=np.zeros(3)), x, atol=1e-9)


@pytest.mark.parametrize("level", [0.0, 5.0])
def test_flat_lead_stays_flat(level):
    clean = denoise_block(np.full((1, 300), level))
    assert np.allclose(clean, level, atol=1e-9)


def test_noise_goes_down():
    t = np.arange(1200) / 100
    sine = np.sin(2 * np.pi * t)
    noisy = sine + np.random.default_rng(1).normal(scale=0.2, size=t.size)
    clean = denoise_block(noisy[None])[0]
    assert np.abs(clean - sine).mean() < 0.6 * np.abs(noisy - sine).mean()


@pytest.fixture(scope="module")
def mixed(spark):
    """Leads of several lengths, a null, an empty one and one with a gap."""
    rng = np.random.default_rng(5)
    signals = {i: rng.normal(size=n).tolist() for i, n in enumerate([64, 299, 64, 5, 1, 300])}
    signals |= {10: None, 11: [], 12: [1.0, None, 2.0, 4.0], 13: [1.0, float("nan"), 3.0]}
    return spark.createDataFrame(sorted(signals.items()), "id long, signal array<double>")


def test_columns_agree_with_plain_numbers(mixed):
    bands = wavedec(F.col("signal"))
    limit = C.universal_threshold(C.noise_sigma(F.element_at("bands", -1)), F.size("signal"))
    rows = (
        mixed.where("id < 10")
        .withColumn("bands", bands)
        .withColumn("limit", limit)
        .select(
            "id",
            "signal",
            denoise(F.col("signal")).alias("clean"),
            waverec(F.col("bands"), F.size("signal")).alias("same"),
            waverec(C.threshold_bands(F.col("bands"), F.col("limit")), F.size("signal")).alias(
                "composed"
            ),
        )
        .collect()
    )
    assert len(rows) == 6
    for row in rows:
        x = np.array(row["signal"])
        assert len(row["clean"]) == len(x)
        assert np.allclose(row["clean"], plain_denoise(x), atol=1e-12)
        assert np.allclose(row["composed"], row["clean"], atol=1e-12)
        assert np.allclose(row["same"], x, atol=1e-9)


def test_missing_values(mixed):
    rows = {
        r["id"]: r
        for r in mixed.select(
            "id",
            denoise(F.col("signal")).alias("clean"),
            wavedec(F.col("signal")).alias("bands"),
            C.noise_sigma(F.element_at(wavedec(F.col("signal")), 5)).alias("sigma"),
        )
        .where("id >= 10 and id <> 11")
        .collect()
    }
    assert rows[10]["clean"] is None and rows[10]["bands"] is None
    assert np.isnan(rows[12]["clean"]).all() and len(rows[12]["clean"]) == 4
    assert np.isnan(rows[13]["clean"]).all()
    assert np.isnan(rows[13]["sigma"])
    empty = mixed.where("id = 11").select(denoise(F.col("signal")).alias("clean")).first()
    assert empty["clean"] == []


def test_whole_recordings_match_single_leads(mixed):
    nested = mixed.where("id < 6").select(
        "id", "signal", F.array("signal", F.reverse("signal")).alias("signals")
    )
    nested = nested.unionByName(
        nested.limit(1).select(
            F.lit(99).cast("long").alias("id"),
            "signal",
            F.lit(None).cast("array<array<double>>").alias("signals"),
        )
    ).repartition(2)
    rows = nested.select(
        "id",
        denoise_all(F.col("signals")).alias("all"),
        denoise(F.col("signal")).alias("a"),
        denoise(F.reverse("signal")).alias("b"),
    ).collect()
    for row in rows:
        if row["id"] == 99:
            assert row["all"] is None
        else:
            assert row["all"] == [row["a"], row["b"]]


def test_other_wavelets_are_refused():
    with pytest.raises(ValueError):
        denoise(F.col, "db4")
    with pytest.raises(ValueError):
        wavedec(F.col, level=0)
