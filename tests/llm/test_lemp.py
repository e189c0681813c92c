"""Operator 13 against scores of all documents for all items."""

import math
import random
import re

import numpy as np
import pytest
from cases import awkward, empty

from wavelead.llm import lemp
from wavelead.llm.lemp import Best, Bucket, ranked_search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def expected(docs, items, k):
    words = [(d, plain_terms(t)) for d, t in docs]
    size = sum(1 for _, w in words if w)
    total = sum(len(w) for _, w in words)
    holds = {}
    for _, w in words:
        for t in set(w):
            holds[t] = holds.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    rows = []
    for item, terms in asked.items():
        found = []
        for doc_id, w in words:
            if w:
                m = 100 - 50 + (50 * len(w) * size) // total
                score = sum(
                    math.floor(1000 * math.log((2 * size + 2) / (2 * holds[t] + 1)))
                    * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 20 * m))
                    for t in terms & set(w)
                )
                if score > 0:
                    found.append((-score, doc_id is not None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1):
            rows.append((item, rank, doc_id, -score))
    return rows


def key(row):
    return tuple((v is not None, v) for v in row)


def same(spark, docs, items, k, **options):
    found = ranked_search(
        docs, spark.createDataFrame(items, "item_id long, text string, score string"), k, **options
    ).collect()
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    wanted = expected(texts, [i[:2] for i in items], k)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    return wanted


ITEMS = [
    (1, "one two three w1 w2 w3 w4", "x"),
    (2, "ONE! héllo ß 漢字", None),
    (3, None, None),
    (4, "", None),
    (5, "... ---", None),
    (6, "word nowhere", None),
    (None, "changed words w5 x3y", None),
    (7, "a b", None),
    (7, "c line", None),
    (8, "a b", None),
]


def test_terms_are_those_of_the_pattern():
    chance = random.Random(1)
    for _ in range(500):
        text = "".join(chance.choice("aZ09@`[{/: \x00\x1c\x85\xa0éÀ漢🙂\x7f\n") for _ in range(chance.randrange(20)))
        assert [t.decode() for t in terms_of(text)] == plain_terms(text)


@pytest.mark.parametrize("k", [1, 2, 50])
def test_awkward_tables(spark, k):
    assert same(spark, awkward(spark), ITEMS, k)


def test_blocks_of_items(spark):
    same(spark, awkward(spark), ITEMS, 3, item_bytes=20)


def test_empty_tables(spark):
    assert same(spark, empty(spark), ITEMS, 5) == []
    assert same(spark, spark.createDataFrame([(1, None)], "doc_id long, text string"), ITEMS, 5) == []
    assert ranked_search(awkward(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_pruned_search_equals_all_scores(spark, monkeypatch):
    """Many small buckets and blocks, frequent words, copies, and documents that hold items."""
    chance = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]

    def text(n):
        return " ".join(chance.choices(words, weights, k=n))

    items = [(k, text(chance.randrange(1, 40)), None) for k in range(25)]
    docs = [(k, text(chance.randrange(0, 120))) for k in range(1500)]
    docs += [(2000 + k, f"{text(20)} {items[k % 25][1]} {text(5)}") for k in range(100)]
    docs += [(3000 + k, items[3][1]) for k in range(300)]
    monkeypatch.setattr(lemp, "BUCKET", 16)
    monkeypatch.setattr(lemp, "BLOCK_IMPACTS", 3000)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert len(same(spark, frame, items, 20)) == 500


def test_bounds_leave_documents_out(monkeypatch):
    chance = np.random.default_rng(2)
    looked = []
    original = Bucket.candidates

    def watched(self, asked, least):
        rows, scores = original(self, asked, least)
        looked.append(len(rows))
        return rows, scores

    monkeypatch.setattr(Bucket, "candidates", watched)
    n, terms = 20_000, 50
    size = chance.integers(1, 12, n)
    term = np.concatenate([np.sort(chance.choice(terms, s, replace=False)) for s in size])
    impact = chance.integers(1, 10**6, len(term)) * (term + 1)
    items = [np.array([3, 20, 49]), np.array([1])]
    best = [Best(10) for _ in items]
    import pyarrow as pa

    lemp.search_block(best, items, pa.array(np.arange(n)), size, term, impact)
    row = np.repeat(np.arange(n), size)
    for item, found in zip(items, best):
        scores = np.bincount(row, np.where(np.isin(term, item), impact, 0), n).astype(np.int64)
        order = np.lexsort((np.arange(n), -scores))[:10]
        assert found.ids.tolist() == order.tolist() and found.scores.tolist() == scores[order].tolist()
    assert sum(looked) < n / 10
