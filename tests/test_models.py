import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from wavelead.operators.features import FEATURES, lead_features, record_features
from wavelead.operators.folds import assign_folds, group_folds
from wavelead.operators.models import (
    accuracy,
    out_of_fold,
    permutation_importance,
    permute_column,
    stacking,
)


@pytest.fixture(scope="module")
def rows(spark):
    """Groups of unequal size; feature a carries the label, b is noise."""
    rng = np.random.default_rng(2)
    data, key = [], 0
    for group in range(30):
        for _ in range(200 if group == 0 else 3):
            label = group % 2
            data.append((key, group, label, float(label + rng.normal(scale=0.15)), float(rng.normal())))
            key += 1
    return spark.createDataFrame(data, "id long, group long, label int, a double, b double")


def test_folds_follow_the_groups(rows):
    folds = group_folds(rows, 5).collect()
    expected = {}
    for label in (0, 1):
        for i, group in enumerate(g for g in range(30) if g % 2 == label):
            expected[group] = i % 5
    assert {r["group"]: r["fold"] for r in folds} == expected
    assigned = assign_folds(rows, 5)
    assert assigned.count() == rows.count()
    per_group = assigned.groupBy("group").agg(F.count_distinct("fold").alias("n"))
    assert per_group.where("n <> 1").isEmpty()


def test_scores_are_out_of_fold(rows):
    scored = out_of_fold(assign_folds(rows, 3), ["a", "b"], ("logistic", "forest"))
    table = scored.toPandas()
    assert len(table) == 2 * rows.count()
    assert table.groupby("model").id.nunique().tolist() == [rows.count()] * 2
    assert table.p.between(0, 1).all()
    quality = {r["model"]: r["accuracy"] for r in accuracy(scored, ["model"]).collect()}
    assert min(quality.values()) > 0.85


def test_stacking_uses_all_scores(rows):
    truth = assign_folds(rows, 3)
    good = rows.select("id", F.col("a").alias("p"))
    bad = rows.select("id", F.col("b").alias("p"))
    scored = stacking({"good": good, "bad": bad}, truth)
    assert accuracy(scored, []).first()["accuracy"] > 0.85


def test_permuting_keeps_the_values(rows):
    mixed = permute_column(rows, "a").toPandas()
    before = rows.toPandas()
    assert sorted(mixed.a) == sorted(before.a)
    assert mixed.sort_values("id").b.tolist() == before.sort_values("id").b.tolist()
    moved = mixed.sort_values("id").a.to_numpy() != before.sort_values("id").a.to_numpy()
    assert moved.mean() > 0.9


def test_importance_finds_the_feature(rows):
    drops = {
        r["feature"]: r["accuracy_drop"]
        for r in permutation_importance(assign_folds(rows, 3), ["a", "b"]).collect()
    }
    assert drops["a"] > 0.2 and abs(drops["b"]) < 0.05


def test_gaps_are_filled_and_folds_are_few(rows):
    gaps = rows.withColumn("b", F.when(F.col("id") % 3 == 0, float("nan")).when(F.col("id") % 3 == 1, F.col("b")))
    scored = out_of_fold(assign_folds(gaps, 3), ["a", "b"], ("logistic",))
    assert accuracy(scored, []).first()["accuracy"] > 0.85
    with pytest.raises(ValueError):
        out_of_fold(rows.withColumn("fold", F.col("id")), ["a"], ("logistic",))


def test_models_score_in_a_session_that_has_observed_a_query(rows):
    seen = Observation("rows")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == rows.count()
    folds = assign_folds(rows, 3)
    scored = out_of_fold(folds, ["a", "b"], ("logistic", "forest")).toPandas()
    assert len(scored) == 2 * rows.count() and scored.p.between(0, 1).all()
    assert permutation_importance(folds, ["a", "b"], columns=["a"]).first()["n"] == rows.count()


def test_features(spark):
    x = [1.0, -2.0, 3.0, 0.0, -1.0]
    df = spark.createDataFrame(
        [(1, 0, x), (1, 1, [2.0] * 4), (2, 0, None)],
        "patient_id long, lead_idx int, signal array<double>",
    )
    table = {(r["patient_id"], r["lead_idx"]): r for r in lead_features(df).collect()}
    row = table[1, 0]
    assert row["mean"] == pytest.approx(0.2) and row["std"] == pytest.approx(np.std(x))
    assert (row["min"], row["max"], row["median"]) == (-2.0, 3.0, 0.0)
    assert row["rms"] == pytest.approx(np.sqrt(3.0)) and row["peak_to_peak"] == 5.0
    assert row["zero_crossings"] == 2
    assert np.isnan(table[2, 0]["mean"])
    wide = record_features(lead_features(df), n_leads=2).where("patient_id = 1").first()
    assert len(wide) == 1 + 2 * len(FEATURES) and wide["l1_mean"] == 2.0
