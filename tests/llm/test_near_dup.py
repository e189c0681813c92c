"""Operator 4 against comparing all pairs."""

import random

import numpy as np
from cases import TEXTS, awkward, empty

from pyspark.sql import functions as F

from wavelead.llm.graph import components
from wavelead.llm.near_dup import common_shingles, links, near_duplicates, signatures
from wavelead.llm.queries import op4_near_dup

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute_force(texts, threshold=85):
    """Component of every id, by comparing all pairs of distinct sets."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if not x or not y or 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
                continue
            i = len(x & y)
            if 100 * i >= threshold * (len(x) + len(y) - i):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in ids}, sets


def check(rows, texts):
    component, sets = brute_force(texts)
    for row in rows:
        k = row["doc_id"]
        assert row["n_shingles"] == len(sets[k])
        assert row["component_id"] == component[k]
        assert row["kept"] == (component[k] == k)


def test_op4(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = op4_near_dup(spark, SF).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_chains_of_copies(spark):
    """A group whose neighbours are alike, but hardly any others, and pairs close to the threshold."""
    chance = random.Random(11)
    texts, words = {}, [f"v{k}" for k in range(400)]
    for k in range(60):
        words = list(words)
        for _ in range(chance.choice([2, 5, 6, 7])):
            words[chance.randrange(len(words))] = f"n{chance.random()}"
        texts[k] = " ".join(words)
    for k in range(60, 90):
        texts[k] = texts[k - 60].upper() if k % 2 else texts[k - 60] + " tail" * (k % 7)
    chance.shuffle(order := list(texts.items()))
    rows = near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
    assert len(rows) == 90
    check(rows, texts)


def test_tiles_find_what_pivots_leave(spark):
    """Many documents in one bucket, few of them linked: small tiles, no pivots."""
    chance = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    texts = {}
    for k in range(70):
        words = list(base)
        for _ in range(chance.choice([1, 4, 6])):
            words[chance.randrange(len(words))] = f"n{chance.random()}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    signed = signatures(docs)
    nodes = signed.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "u", "v", "sig")
    component, _ = brute_force(texts)
    assert 1 < len(set(component.values())) < 70
    for rounds, tile in ((0, 16), (1, 16)):
        found = {r["node"]: r["component"] for r in links(nodes, docs, rounds=rounds, tile=tile).collect()}
        assert {k: found.get(k, k) for k in texts} == component


def test_an_id_with_several_texts(spark):
    """All that any text of an id is linked with is one class, under its smallest id."""
    chance = random.Random(6)

    def text():
        return [f"w{chance.random()}" for _ in range(120)]

    p, q, r, s = text(), text(), text(), text()
    near = lambda words: [*words[:-2], "other", "end"]
    rows = [(5, p), (5, q), (5, q), (7, near(p)), (3, near(q)), (9, r), (9, s), (8, r), (2, near(near(s))), (11, text())]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string").repartition(3)
    found = {}
    for r_ in near_duplicates(docs).collect():
        found.setdefault(r_["doc_id"], set()).add((r_["component_id"], r_["kept"]))
    assert found == {
        5: {(3, False)}, 7: {(3, False)}, 3: {(3, True)},
        9: {(2, False)}, 8: {(2, False)}, 2: {(2, True)}, 11: {(11, True)},
    }


def test_common_shingles():
    chance = np.random.default_rng(3)
    sets = [np.unique(chance.integers(0, 30, n)) for n in (0, 5, 20, 40, 9)]
    counts = common_shingles(sets, np.array([0, 1]), np.array([2, 3, 4]))
    assert counts.tolist() == [[len(np.intersect1d(sets[i], sets[j])) for j in (2, 3, 4)] for i in (0, 1)]


def test_awkward_tables(spark):
    rows = near_duplicates(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    without = [r for r in rows if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in without] == [(None, True)]
    check([r for r in rows if r["doc_id"] is not None], {k: t for k, t in enumerate(TEXTS) if k != 3})
    assert near_duplicates(empty(spark)).count() == 0


def test_components_of_long_paths(spark):
    chance = random.Random(2)
    names = list(range(300))
    chance.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(299) if k % 100 != 99] + [(5, 5)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    for part in range(3):
        group = names[100 * part : 100 * part + 100]
        assert {found[n] for n in group} == {min(group)}
