"""Operator 9: held-out accuracy, and the trees against plain traversal."""

import zlib

import numpy as np
from cases import TEXTS, awkward, empty

from wavelead.llm.boosting import fit
from wavelead.llm.quality import FEATURES, score_documents, statistics
from wavelead.llm.queries import op9_quality


def area(scores, truth):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    ones = truth == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_op9_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = op9_quality(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count()
    assert rows["score"].between(0, 1).all()
    assert ((rows["score"] >= 0.3).astype(int) == rows["predicted"]).all()
    assert (rows["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in rows["doc_id"]]).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = rows[rows["held_out"]].merge(labels, on="doc_id")
    truth = held["quality"].to_numpy()
    assert area(held["score"].to_numpy(), truth) > 0.95
    kept = held["predicted"].to_numpy() == 1
    assert kept[truth == 1].mean() > 0.97
    assert kept[truth == 0].mean() < 0.2


def test_flat_trees_equal_plain_traversal():
    chance = np.random.default_rng(4)
    x = chance.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = fit(x, y, trees=25, depth=3)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    for row in x[:50]:
        total = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            k = 0
            while k < len(feature):
                k = 2 * k + 2 if row[feature[k]] > threshold[k] else 2 * k + 1
            total += leaf[k - len(feature)]
        assert abs(total - forest.margin(row[None])[0]) < 1e-9


def test_labels_of_one_class():
    forest = fit(np.zeros((3, 2)), np.ones(3))
    assert forest.score(np.zeros((1, 2)))[0] == 4 / 5


def test_awkward_tables(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] + [(None, 1), (4, None)], "doc_id long, quality int")
    rows = score_documents(awkward(spark), labels).collect()
    assert len(rows) == len(TEXTS) + 2
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert score_documents(empty(spark), labels).count() == 0
    none = score_documents(awkward(spark), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert len(statistics(None)) == len(FEATURES) and np.isfinite(statistics("")).all()
