import pytest
from pyspark.sql import functions as F

from wavelead.functions.columns import binarize_label, is_junk, soft_threshold
from wavelead.operators.evaluation import confusion, late_fusion, misses
from wavelead.operators.names import parse_names, readable, segment_name, unreadable
from wavelead.operators.records import (
    cohort_summary,
    completeness,
    correct_labels,
    head_profile,
    missing_recordings,
    recording_profile,
)


def test_binary_label(spark):
    rows = [(0, float("nan")), (1, None), (2, -1.0), (3, 0.0), (4, 1.0), (5, 2.0), (6, 3.0)]
    df = spark.createDataFrame(rows, "id int, x double").select("id", binarize_label(F.col("x")))
    assert [r[1] for r in df.orderBy("id").collect()] == [0, 0, 0, 0, 1, 1, 1]


def test_counting_and_binarising_differ_on_odd_labels(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, -1)], "brugada int")
    assert cohort_summary(df).first().asDict() == {"n_total": 5, "n_cases": 2, "n_normal": 1}


@pytest.fixture(scope="module")
def leads(spark):
    nan = float("nan")
    rows = [(1, 8.0, j, f"L{j}", [0.0] * 50) for j in range(3)]
    rows += [(2, 8.0, 0, "L0", [1.0, nan, None])]
    return spark.createDataFrame(
        rows, "patient_id long, fs double, lead_idx int, lead string, signal array<double>"
    )


def test_profile(leads):
    rows = {r["patient_id"]: r for r in recording_profile(leads).collect()}
    assert rows[1]["n_samples"] == 50 and rows[1]["n_leads"] == 3
    assert rows[1]["n_segments"] == 2 and rows[1]["leads"] == ["L0", "L1", "L2"]
    assert rows[2]["n_segments"] == 0 and rows[2]["n_missing"] == 2


def test_head(spark, leads):
    meta = spark.createDataFrame([(3, 0), (1, 1), (2, 0)], "patient_id long, brugada int")
    rows = head_profile(meta, leads, n=2).orderBy("patient_id").collect()
    assert [(r["patient_id"], r["n_leads"]) for r in rows] == [(1, 3), (2, 1)]


def test_missing_recordings(spark, leads):
    meta = spark.createDataFrame([(1, 0), (9, 1)], "patient_id long, brugada int")
    assert [r["patient_id"] for r in missing_recordings(meta, leads).collect()] == [9]
    with pytest.raises(FileNotFoundError):
        missing_recordings(meta, leads, strict=True)
    assert missing_recordings(meta.where("patient_id = 1"), leads, strict=True).isEmpty()


def test_completeness(leads):
    assert completeness(leads).first().asDict() == {"n": 2, "expected": 363, "status": "warn"}
    assert completeness(leads, minimum=2).first()["status"] == "ok"


def test_label_correction(spark):
    meta = spark.createDataFrame(
        [(1, 0), (2, 1), (3, 2), (4, None)], "patient_id long, brugada int"
    )
    fixes = spark.createDataFrame([(1, 2), (2, 1), (4, 1), (8, 1)], "patient_id long, brugada int")
    rows = {r["patient_id"]: (r["brugada"], r["changed"]) for r in correct_labels(meta, fixes).collect()}
    assert rows == {1: (2, True), 2: (1, False), 3: (2, False), 4: (1, True)}


def test_names(spark):
    rows = [
        ("7", "7_1_seg0.npy"),
        ("7", "7_x_seg0.npy"),
        ("a", "7_1_seg1.npy"),
        ("7", "7.npy"),
        ("7", "7_1_seg2.txt"),
        ("8", "8_0_seg10.npy"),
        ("8", "8_1.5_seg11.npy"),
    ]
    parsed = parse_names(spark.createDataFrame(rows, "folder string, name string"), suffix=".npy")
    good = {r["name"]: (r["group"], r["label"]) for r in readable(parsed).collect()}
    assert good == {"7_1_seg0.npy": (7, 1), "8_0_seg10.npy": (8, 0)}
    bad = {(r["folder"], r["name"]): r["reason"] for r in unreadable(parsed).collect()}
    assert bad == {
        ("7", "7_x_seg0.npy"): "label is not a number",
        ("a", "7_1_seg1.npy"): "patient is not a number",
        ("7", "7.npy"): "label is not a number",
        ("8", "8_1.5_seg11.npy"): "label is not a number",
    }


def test_names_round_trip(spark):
    df = spark.createDataFrame([(12, 1, 3)], "p long, l int, s int")
    name = df.select(segment_name(F.col("p"), F.col("l"), F.col("s"), ".npy").alias("name"))
    assert name.first()["name"] == "12_1_seg3.npy"


def test_junk_paths(spark):
    paths = ["a/1.hea", "a/._1.hea", "a/.DS_Store", "__MACOSX/1.hea", "x/__MACOSX/b/1.hea", "a._b"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.where(~is_junk(F.col("path"))).collect()] == ["a/1.hea", "a._b"]


def test_soft_threshold(spark):
    df = spark.createDataFrame([([-3.0, -1.0, 0.0, 0.5, 2.0],)], "x array<double>")
    row = df.select(soft_threshold(F.col("x"), F.lit(1.0)).alias("y")).first()
    assert row["y"] == [-2.0, 0.0, 0.0, 0.0, 1.0]


def test_fusion_and_errors(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 1.0)], "id long, p double")
    b = spark.createDataFrame([(2, 0.0), (3, 1.0)], "id long, p double")
    assert [tuple(r) for r in late_fusion(a, b).collect()] == [(2, 0.65)]
    rows = [(1, 1, 1), (2, 1, 0), (3, 0, 0), (4, 0, 1), (5, 0, 0)]
    df = spark.createDataFrame(rows, "id long, label int, prediction int")
    row = confusion(df).first()
    assert (row["tp"], row["fn"], row["fp"], row["tn"]) == (1, 1, 1, 2)
    assert row["sensitivity"] == 0.5 and row["accuracy"] == 0.6
    found = {r["id"]: r["error"] for r in misses(df, "id").collect()}
    assert found == {2: "missed", 4: "false alarm"}
    none = confusion(df.where("label = 0")).first()
    assert none["sensitivity"] is None
    odd = spark.createDataFrame(
        [(1, 2.0, 0.0), (2, 3.0, 1.0), (3, None, 1.0), (4, 0.0, float("nan")), (5, -1.0, 0.0)],
        "id long, label double, prediction double",
    )
    row = confusion(odd).first()
    assert (row["tp"], row["fn"], row["fp"], row["tn"], row["n_unknown"]) == (1, 1, 0, 1, 2)
    found = {r["id"]: r["error"] for r in misses(odd, "id").collect()}
    assert found == {1: "missed", 3: "unknown", 4: "unknown"}
