"""Operator 7: recall against brute force, exact scores, and copies."""

import numpy as np
from pyspark.sql import types as T

from wavelead.llm.hnsw import nearest_neighbours
from wavelead.llm.queries import op7_hnsw

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("shard", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)


def brute_force(ids, vectors, k=20, every=20):
    vectors = np.asarray(vectors, np.float64)
    ids = np.asarray(ids)
    answers = {}
    for q, x in zip(ids.tolist(), vectors):
        if q % every == 0 and q not in answers:
            score = (vectors * x).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)).tolist() if ids[j] != q][:k]
            answers[q] = [(int(ids[j]), float(score[j])) for j in order]
    return answers


def answers_of(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def recall(found, true):
    assert set(found) == set(true)
    assert all(len(found[q]) == len(true[q]) for q in true)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in true[q]}) for q in true)
    return hits / sum(map(len, true.values()))


def frame(spark, rows):
    return spark.createDataFrame([(k, v, None, None) for k, v in rows], SCHEMA)


def test_op7(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r["vec_id"] for r in table], [r["embedding"] for r in table]
    true = brute_force(ids, vectors)
    found = answers_of(op7_hnsw(spark, sf).collect())
    assert recall(found, true) > 0.97
    exact = {(q, v): s for q, a in brute_force(ids, vectors, k=len(ids)).items() for v, s in a}
    for q, answer in found.items():
        assert answer == sorted(answer, key=lambda x: (-x[1], x[0]))
        assert all(exact[q, v] == s for v, s in answer)


def test_shards_of_random_vectors_of_many_lengths(spark):
    chance = np.random.default_rng(6)
    vectors = (chance.normal(size=(3000, 32)) * chance.lognormal(0, 0.5, (3000, 1))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    found = answers_of(nearest_neighbours(frame(spark, rows), shard_rows=1000).collect())
    assert recall(found, brute_force(range(3000), vectors)) > 0.95


def test_a_third_are_copies(spark):
    chance = np.random.default_rng(2)
    vectors = chance.normal(size=(900, 8)).astype(np.float32)
    vectors[300:600] = vectors[20]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    found = answers_of(nearest_neighbours(frame(spark, rows), shard_rows=200).collect())
    true = brute_force(range(900), vectors)
    assert recall(found, true) > 0.99
    assert found[20] == true[20] and found[320] == true[320]


def recall_of(found, true, part):
    return recall({q: found[q] for q in part}, {q: true[q] for q in part})


def test_every_cluster_is_found(spark):
    """A tight group that points away from all others, and many small groups, on several shards."""
    chance = np.random.default_rng(4)
    main = chance.normal(size=32)
    away = -main + 0.05 * chance.normal(size=(60, 32))
    vectors = np.concatenate([main + 0.3 * chance.normal(size=(9000, 32)), away]).astype(np.float32)
    vectors = vectors[chance.permutation(len(vectors))]
    minority = [k for k in range(len(vectors)) if vectors[k] @ main < 0]
    every = [k for k in minority if k % 4 == 0]
    for shard_rows in (16_384, 3000):
        rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
        found = answers_of(nearest_neighbours(frame(spark, rows), every=4, shard_rows=shard_rows).collect())
        true = brute_force(range(len(vectors)), vectors, every=4)
        assert recall_of(found, true, every) > 0.95
        assert recall_of(found, true, [q for q in true if q not in every]) > 0.9
    centres = 3 * chance.normal(size=(150, 32))
    vectors = (np.repeat(centres, 40, axis=0) + 0.2 * chance.normal(size=(6000, 32))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    found = answers_of(nearest_neighbours(frame(spark, rows), every=5, shard_rows=2000).collect())
    true = brute_force(range(6000), vectors, every=5)
    worst = min(recall_of(found, true, [q for q in true if q // 40 == c]) for c in range(150))
    assert worst >= 0.9


def test_more_neighbours_than_the_default(spark):
    chance = np.random.default_rng(9)
    vectors = chance.normal(size=(1500, 8)).astype(np.float32)
    vectors[300:400] = vectors[40]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    for k in (50, 250):
        found = answers_of(nearest_neighbours(frame(spark, rows), k=k, shard_rows=800).collect())
        true = brute_force(range(1500), vectors, k=k)
        assert recall(found, true) > 0.98
        assert found[40][:50] == true[40][:50]


def test_the_query_of_a_repeated_id(spark):
    rows = [(0, [2.0, 1.0]), (0, [1.0, 5.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    found = answers_of(nearest_neighbours(frame(spark, rows)).collect())
    assert found == {0: [(2, 5.0), (1, 1.0)]}


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0])]
    rows += [(120, [None, 1.0]), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (160, [])]
    found = answers_of(nearest_neighbours(frame(spark, rows)).collect())
    assert found == {0: [(5, 1.0), (5, 1.0), (20, 0.0)], 20: [(5, 2.0), (5, 2.0), (0, 0.0)]}
    assert nearest_neighbours(frame(spark, [])).count() == 0
    assert nearest_neighbours(frame(spark, [(20, [1.0])])).count() == 0
