"""Operator 5: gradients by differences, scores by plain sums, and what the model has learned."""

import random

import numpy as np
from cases import TEXTS, awkward, empty

from wavelead.llm import pseudo_lm as lm
from wavelead.llm.queries import op5_pseudo_likelihood

SF = "/root/testdata/sf0.01"


def plain_score(w, words):
    """Word by word, with the whole vocabulary written out."""
    total = 0.0
    line = [lm.EDGE] * lm.SIDE + list(words) + [lm.EDGE] * lm.SIDE
    for k, word in enumerate(words):
        around = line[k : k + lm.SIDE] + line[k + lm.SIDE + 1 : k + 2 * lm.SIDE + 1]
        seen = np.concatenate([w.embed[p, i] for p, i in enumerate(around)])
        hidden = np.tanh(seen @ w.inner + w.inner_bias)
        classes = hidden @ w.classes + w.class_bias
        inside = np.einsum("h,chm->cm", hidden, w.members) + w.member_bias
        p = (np.exp(classes) / np.exp(classes).sum())[:, None] * np.exp(inside) / np.exp(inside).sum(axis=1)[:, None]
        assert abs(p.sum() - 1) < 1e-4
        total += np.log(p.ravel()[word])
    return total


def test_scores_equal_plain_sums(spark):
    weights = lm.Weights.fresh(3)
    rows = spark.createDataFrame([(1, "one two three two"), (2, ""), (3, None), (4, "One")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in lm.score(rows, weights).collect()}
    ids = lm.WordIds()
    for k, text in ((1, "one two three two"), (4, "one")):
        assert abs(found[k]["log_likelihood"] - plain_score(weights, ids.of(text).tolist())) < 1e-3
    assert (found[2]["log_likelihood"], found[2]["mean_log_likelihood"], found[3]["n_words"]) == (0.0, None, 0)


def test_gradients():
    chance = np.random.default_rng(1)
    w = lm.Weights(*[a.astype(np.float64) for a in lm.Weights.fresh(2).arrays()])
    around, words = chance.integers(0, lm.VOCABULARY + 1, (40, 4)), chance.integers(0, lm.VOCABULARY, 40)
    around[:, 1] = around[0, 1]
    for value, change in zip(w.arrays(), lm.gradients(w, around, words).arrays()):
        where = np.unravel_index(np.abs(change).argmax(), value.shape)
        old = value[where]
        value[where] = old + 1e-4
        up = -lm.log_probabilities(w, around, words).mean()
        value[where] = old - 1e-4
        down = -lm.log_probabilities(w, around, words).mean()
        value[where] = old
        assert abs((up - down) / 2e-4 - change[where]) < 1e-5


def test_pack_round_trip():
    w = lm.Weights.fresh(9)
    assert all((a == b).all() for a, b in zip(w.arrays(), lm.Weights.unpack(w.pack()).arrays()))


def test_learned_from_all_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(lm, "FAN", 2)  # more than one level of averages
    weights = lm.train(docs.repartition(6, "doc_id"), group_words=40_000)
    real = docs.select("doc_id", "text").collect()
    chance = random.Random(1)
    mixed = []
    for doc_id, text in real:
        words = text.split()
        chance.shuffle(words)
        mixed.append((doc_id, " ".join(words)))

    def mean(frame, w):
        rows = lm.score(frame, w).collect()
        return sum(r["log_likelihood"] for r in rows) / sum(r["n_words"] for r in rows)

    learned = mean(docs, weights)
    assert learned > mean(docs, lm.Weights.fresh()) + 0.5
    assert learned > mean(spark.createDataFrame(mixed, "doc_id long, text string"), weights)


def test_the_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 7 = 0"))  # repeated rows
    scores = []
    for parts in (1, 6):
        dealt = docs.repartition(parts, "lang", "doc_id")
        weights = lm.train(dealt, group_words=20_000)
        scores.append((weights.pack(), sorted(map(tuple, lm.score(dealt, weights).collect()))))
    assert np.array_equal(scores[0][0], scores[1][0])
    for one, other in zip(scores[0][1], scores[1][1]):
        assert one[:2] == other[:2] and np.isclose(one[2], other[2], rtol=1e-5)


def test_every_word_is_learned_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lm.Learner, "step", lambda self, around, words: seen.append(words))
    chance = np.random.default_rng(1)
    documents = [chance.integers(0, lm.VOCABULARY, n).astype("<u2") for n in (1, 7, 0, 9000, 70_000, 3)]
    assert lm.learn_documents(lm.Learner(lm.Weights.fresh()), iter(documents)) == 79_011
    assert np.array_equal(np.concatenate(seen), np.concatenate(documents))
    assert max(map(len, seen)) <= lm.BATCH


def test_columns_and_texts_have_the_same_ids():
    import pyarrow as pa

    texts = ["One two  ÀB\x85c", None, "", " \n", *[t or "" for t in TEXTS]]
    ids, ends = lm.WordIds().of_column(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == lm.WordIds().of(text).tolist()


def test_op5(spark):
    rows = op5_pseudo_likelihood(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 200
    assert all(r["log_likelihood"] <= 0 for r in rows)


def test_awkward_tables(spark):
    rows = lm.pseudo_likelihood(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    assert all(np.isfinite(r["log_likelihood"]) for r in rows)
    assert lm.pseudo_likelihood(empty(spark)).count() == 0
