import pytest
from pyspark.sql import functions as F

from wavelead.functions.columns import sample_major
from wavelead.operators.dataset import (
    collate,
    collect_recordings,
    dataset_report,
    dataset_rows,
    shape_rejects,
)
from wavelead.operators.segment import segment_leads, segment_recordings

SHAPE = (4, 3)


@pytest.fixture(scope="module")
def leads(spark):
    def recording(patient, lengths, numbers=None):
        numbers = numbers or range(len(lengths))
        return [
            (patient, patient % 2, 4.0, j, f"L{j}", [100.0 * j + i for i in range(n)])
            for j, n in zip(numbers, lengths)
        ]

    rows = [
        *recording(1, [8, 8, 8]),
        *recording(2, [9, 9, 9]),
        *recording(3, [8, 8]),
        *recording(4, [8, 8, 8, 8]),
        *recording(5, [3, 3, 3]),
        *recording(6, [8, 8, 8], [0, 1, 1]),
        *recording(7, [8, 8, 4]),
    ]
    return spark.createDataFrame(
        rows,
        "patient_id long, label int, fs double, lead_idx int, lead string, signal array<double>",
    )


def by_segment(leads):
    return collate(segment_leads(leads, duration=1), SHAPE[1])


def by_recording(leads):
    return segment_recordings(collect_recordings(leads, SHAPE[1]), SHAPE[1], duration=1)


@pytest.mark.parametrize("plan", [by_segment, by_recording])
def test_only_the_right_shape_is_kept(leads, plan):
    rows = {(r["group"], r["seg_idx"]): r for r in dataset_rows(plan(leads), SHAPE).collect()}
    assert sorted(rows) == [(1, 0), (1, 1), (2, 0), (2, 1), (7, 0)]
    row = rows[2, 1]
    assert row["x"] == [[100.0 * j + i for i in range(4, 8)] for j in range(3)]
    assert (row["label"], row["n_samples"], row["n_leads"]) == (0, 4, 3)


@pytest.mark.parametrize("plan", [by_segment, by_recording])
def test_the_rest_has_a_reason(leads, plan):
    found = {
        (r["patient_id"], r["seg_idx"]): r["reason"]
        for r in shape_rejects(plan(leads), SHAPE).collect()
    }
    assert found == {
        (3, 0): "shape (4, 2)",
        (3, 1): "shape (4, 2)",
        (4, 0): "shape (4, 4)",
        (4, 1): "shape (4, 4)",
        (6, 0): "a lead is missing",
        (6, 1): "a lead is missing",
        (7, 1): "shape (4, 2)",
    }


def test_copies_are_rejected_and_stay_small(leads):
    """A lead repeated very often is a reject; only one array of it is kept."""
    many = F.explode(F.sequence(F.lit(1), F.lit(2000)))
    copies = leads.where("patient_id = 1").withColumn("copy", many).drop("copy")
    collated = collate(segment_leads(copies, duration=1), SHAPE[1])
    rows = collated.collect()
    assert [(r["n_leads"], len(r["x"])) for r in rows] == [(6000, 3), (6000, 3)]
    assert dataset_rows(collated, SHAPE).isEmpty()
    assert dataset_rows(by_recording(copies), SHAPE).isEmpty()


def test_wrong_length(leads):
    assert dataset_rows(by_segment(leads), (5, 3)).isEmpty()
    assert shape_rejects(by_segment(leads), (5, 3)).count() == 12


def test_sample_major(leads):
    row = dataset_rows(by_segment(leads), SHAPE).where("group = 1 and seg_idx = 0").first()
    flat = dataset_rows(by_segment(leads), SHAPE).withColumn("x", sample_major(F.col("x")))
    turned = flat.where("group = 1 and seg_idx = 0").first()["x"]
    assert turned == [list(t) for t in zip(*row["x"])]


def test_report(leads):
    rows = dataset_rows(by_segment(leads), SHAPE)
    report = dataset_report(rows, SHAPE, strict=True).first()
    assert report["n_rows"] == 5 and report["n_groups"] == 3 and report["ok"]
    assert (report["n_positive"], report["n_negative"]) == (3, 2)
    empty = dataset_report(rows.where("group = 99"), SHAPE).first()
    assert empty["n_rows"] == 0 and not empty["ok"]
    with pytest.raises(ValueError):
        dataset_report(rows.where("group = 99"), SHAPE, strict=True)
    with pytest.raises(ValueError):
        dataset_report(rows, (300, 12), strict=True)
