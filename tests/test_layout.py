import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelead.functions import columns as C
from wavelead.operators.denoising import clean_leads, denoise_samples
from wavelead.operators.layout import arrays_to_samples, index_samples, samples_to_arrays
from wavelead.operators.ranking import row_index
from wavelead.operators.segment import segment_leads, segment_samples, unsegmentable
from wavelead.functions.wavelet import denoise_block


@pytest.fixture(scope="module")
def skewed(spark):
    """A key with most of the rows, small keys and a null key, in random order."""
    rows = [("hot", t, f"x{t}") for t in range(900)]
    rows += [(f"k{k}", t, "y") for k in range(40) for t in range(k % 5)]
    rows += [(None, t, "z") for t in range(7)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "id string, t int, payload string").repartition(5)


def test_row_index_is_the_position_in_the_group(skewed):
    rows = row_index(skewed, ["id"], ["t"], count="n").collect()
    assert len(rows) == skewed.count()
    assert all(r["i"] == r["t"] for r in rows)
    sizes = Counter(r["id"] for r in rows)
    assert all(r["n"] == sizes[r["id"]] for r in rows)
    assert {r["payload"] for r in rows if r["id"] == "hot"} == {f"x{t}" for t in range(900)}


def test_row_index_over_everything(skewed):
    numbered = row_index(skewed, [], ["id", "t"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    rows = numbered.orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(skewed.count()))
    keys = [(r["id"] is not None, r["id"] or "", r["t"]) for r in rows]
    assert keys == sorted(keys)


def test_samples_and_arrays_are_inverse(spark):
    rng = np.random.default_rng(0)
    lengths = {1: 10, 2: 16, 3: 17, 4: 64, 5: 1}
    rows = [(p, 0, i, float(v)) for p, n in lengths.items() for i, v in enumerate(rng.normal(size=n))]
    samples = spark.createDataFrame(rows, "patient_id long, lead_idx int, i long, value double")
    chunks = samples_to_arrays(samples, chunk=16)
    assert {(r["patient_id"], r["chunk_idx"]): (r["start"], len(r["signal"])) for r in chunks.collect()} == {
        (1, 0): (0, 10),
        (2, 0): (0, 16),
        (3, 0): (0, 16),
        (3, 1): (16, 1),
        **{(4, c): (16 * c, 16) for c in range(4)},
        (5, 0): (0, 1),
    }
    back = arrays_to_samples(chunks, start="start").collect()
    assert sorted(map(tuple, back)) == sorted(rows)


def test_halo_holds_the_neighbours(spark):
    samples = spark.range(100).select(
        F.lit(1).alias("patient_id"), F.lit(0).alias("lead_idx"), F.col("id").alias("i"),
        F.col("id").cast("double").alias("value"),
    )
    chunks = {r["chunk_idx"]: r for r in samples_to_arrays(samples, 32, 40).collect()}
    assert sorted(chunks) == [0, 1, 2, 3]
    for c, row in chunks.items():
        first, last = max(0, 32 * c - 40), min(100, 32 * (c + 1) + 40)
        assert row["start"] == first
        assert row["signal"] == [float(v) for v in range(first, last)]


def test_long_leads_are_denoised_as_a_whole(spark):
    """Chunked work gives what the transform of the whole lead gives."""
    rng = np.random.default_rng(8)
    leads = {1: 2000, 2: 1025, 3: 1024, 4: 1023, 5: 300, 6: 2049, 7: 1, 8: 2561, 9: 1500}
    signals = {p: rng.normal(size=n).cumsum() for p, n in leads.items()}
    signals[9][700] = np.nan
    rows = [(p, 0, i, float(v)) for p, x in signals.items() for i, v in enumerate(x)]
    samples = spark.createDataFrame(rows, "patient_id long, lead_idx int, i long, value double")
    out = denoise_samples(samples, chunk=1024, halo=512).toPandas()
    assert len(out) == len(rows)
    for p, x in signals.items():
        part = out[out.patient_id == p].sort_values("i")
        assert part.i.tolist() == list(range(len(x)))
        expected = denoise_block(x[None])[0]
        assert np.allclose(part.value.to_numpy(), expected, atol=1e-9, equal_nan=True), p


def test_chunks_must_fit_the_transform(spark):
    samples = spark.createDataFrame([], "patient_id long, lead_idx int, i long, value double")
    with pytest.raises(ValueError):
        denoise_samples(samples, chunk=1000)
    with pytest.raises(ValueError):
        denoise_samples(samples, chunk=1024, halo=256)


def lead_frame(spark, signals, fs=8.0):
    rows = [(p, fs, 0, "I", x) for p, x in signals.items()]
    return spark.createDataFrame(
        rows, "patient_id long, fs double, lead_idx int, lead string, signal array<double>"
    )


def test_windows(spark):
    signals = {p: [float(v) for v in range(n)] for p, n in {1: 0, 2: 23, 3: 24, 4: 48, 5: 71}.items()}
    signals[6] = None
    rows = segment_leads(lead_frame(spark, signals)).collect()
    found = {(r["patient_id"], r["seg_idx"]): r["samples"] for r in rows}
    assert sorted(found) == [(3, 0), (4, 0), (4, 1), (5, 0), (5, 1)]
    assert found[5, 1] == [float(v) for v in range(24, 48)]
    counted = lead_frame(spark, signals).select(
        "patient_id", C.count_windows(F.col("signal"), C.window_size(F.col("fs"))).alias("n")
    )
    assert {r[0]: r[1] for r in counted.collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 0}


def test_rate_without_a_window(spark):
    for rate in (float("nan"), float("inf"), 1e10, -8.0, None):
        odd = lead_frame(spark, {1: [1.0] * 30}).withColumn("fs", F.lit(rate).cast("double"))
        assert segment_leads(odd).count() == 0 and unsegmentable(odd).count() == 1
    leads = lead_frame(spark, {1: [1.0] * 30}).withColumn("fs", F.lit(0.2))
    assert segment_leads(leads).count() == 0
    assert [r["patient_id"] for r in unsegmentable(leads).collect()] == [1]
    with pytest.raises(ValueError):
        segment_leads(leads, fs=0.2)
    with pytest.raises(ValueError):
        segment_samples(leads, 0)


@settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.integers(0, 90), min_size=1, max_size=6), st.integers(1, 30))
def test_segments_are_a_prefix(spark, lengths, size):
    signals = {p: [float(v) for v in range(n)] for p, n in enumerate(lengths)}
    leads = lead_frame(spark, signals, fs=float(size))
    by_array = segment_leads(leads, duration=1).select("patient_id", "seg_idx", "samples")
    by_sample = segment_samples(arrays_to_samples(leads), size).select(
        "patient_id", "seg_idx", "samples"
    )
    rows = sorted(map(tuple, by_array.collect()))
    assert rows == sorted(map(tuple, by_sample.collect()))
    for p, signal in signals.items():
        joined = [v for r in rows if r[0] == p for v in r[2]]
        assert joined == signal[: len(signal) // size * size]


def test_order_of_time_with_ties(spark):
    rows = [(1, 0, t // 2, t, float(t)) for t in range(20)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "patient_id long, lead_idx int, ts int, tie int, value double")
    assert all(r["i"] == r["tie"] for r in index_samples(df, ["ts", "tie"]).collect())


def test_cleaning_steps_chain(spark):
    leads = lead_frame(spark, {1: [1.0, 2.0, 3.0]})
    double = lambda c: F.transform(c, lambda v: v * 2)
    shift = lambda c: F.transform(c, lambda v: v + 1)
    assert clean_leads(leads, double, shift).first()["signal"] == [3.0, 5.0, 7.0]
