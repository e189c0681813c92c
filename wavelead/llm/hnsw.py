"""Nearest neighbours by inner product: a navigable small-world graph per shard, shard results merged.

Vectors are dealt by a hash of their id into shards of ``SHARD_ROWS`` on
average. Every shard gets a hierarchical graph: a node is in layer l with a
chance of 1 / LINKS per layer, all are in layer 0. Its links in a layer come
from its nearest nodes there, those left out to which a chosen one is nearer
than the node itself; links go both ways, up to ``2 * LINKS``. A graph is stored
as flat arrays, one table row per shard. A search goes down the layers, keeping
the best nodes met as starts for the next, and keeps a beam of ``BEAM`` in layer
0; many queries take their steps together. Nodes are the distinct vectors of a
shard, so copies of a vector, however many, are one node with a list of ids.

Every node is a landmark or linked from one: nodes are gone through from the top
layer down, and those that no landmark so far links to become landmarks. A
search in layer 0 starts from the best of the landmarks too, so a small group of
vectors that no way from the top leads to is found all the same.

Near means a large inner product, in building a graph as in searching it, so
long vectors are linked from everywhere as they are found from everywhere. The
steps take single precision; what a shard returns is scored anew in double
precision on the original vectors, and the best of all shards are kept.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do those of another length than most (of equally frequent lengths the
larger counts). A query finds all candidates if they are fewer than ``k``. Rows
that repeat an id are candidates as often as they occur, once each; if their
vectors differ, the query is the smallest of them in the order of arrays. A null
id takes no part. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelead.storage import materialize

NEAREST = 20
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
LINKS = 16
NEAR = 48
BEAM = 192
STARTS = 16
LANDMARKS = 32
STEP = 4
GRAPH = (
    "shard int, n int, width int, vectors binary, ids binary, id_ends binary, "
    "layer_nodes array<binary>, layer_links array<binary>, landmarks binary"
)


def levels(n: int) -> np.ndarray:
    """Layer of every node, by a fixed chance."""
    chance = np.random.default_rng(20).random(n)
    return np.floor(-np.log(np.maximum(chance, 1e-12)) / np.log(LINKS)).astype(np.int64)


def nearest(points: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest other points of every point, nearest first; by blocks of inner products."""
    n = len(points)
    k = min(k, n - 1)
    found = np.empty((n, k), np.int64)
    for at in range(0, n, 512):
        near = points[at : at + 512] @ points.T
        rows = np.arange(len(near))
        near[rows, at + rows] = -np.inf
        best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-near, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable")
        found[at : at + 512] = np.take_along_axis(best, order, 1)
    return found


def diverse(points: np.ndarray, found: np.ndarray, links: int) -> np.ndarray:
    """Mask of the candidates to link: not those to which a chosen one is nearer than the node."""
    kept = np.zeros(found.shape, bool)
    for at in range(0, len(found), 256):
        near = points[found[at : at + 256]]
        own = np.einsum("nd,nkd->nk", points[at : at + 256], near)
        among = np.einsum("nid,njd->nij", near, near, optimize=True)
        mask = kept[at : at + 256]
        for j in range(found.shape[1]):
            hidden = (mask[:, :j] & (among[:, j, :j] > own[:, j, None])).any(axis=1)
            mask[:, j] = ~hidden & (mask.sum(axis=1) < links)
    return kept


def layer(points: np.ndarray) -> np.ndarray:
    """Links of every point, at most 2 * LINKS, filled up with -1."""
    n, width = len(points), 2 * LINKS
    table = np.full((n, width), -1, np.int32)
    if n < 2:
        return table
    found = nearest(points, NEAR)
    kept = diverse(points, found, LINKS)
    a, b = np.repeat(np.arange(n), kept.sum(axis=1)), found[kept]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    near = np.einsum("nd,nd->n", points[a], points[b])
    order = np.lexsort((-near, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    fits = place < width
    table[a[fits], place[fits]] = b[fits]
    return table


def build(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from 0 up: the nodes of each, and their links as positions among them."""
    level = levels(len(points))
    layers = []
    for number in range(int(level.max()) + 1 if len(level) else 0):
        nodes = np.flatnonzero(level >= number)
        layers.append((nodes.astype(np.int32), layer(points[nodes])))
    return layers


def landmarks(layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Nodes that together link to all others in layer 0, those of upper layers first."""
    links = layers[0][1]
    covered = np.zeros(len(links) + 1, bool)
    chosen = []
    for nodes, _ in layers[::-1]:
        for node in nodes.tolist():
            if not covered[node]:
                chosen.append(node)
                covered[node] = True
                covered[links[node]] = True  # -1 is the place beyond the last node
    return np.array(chosen, np.int32)


def walk(points: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> np.ndarray:
    """Beam search in one layer for all queries together: the nodes found, best first, -1 where fewer."""
    rows = np.arange(len(queries))[:, None]
    seen = np.zeros((len(queries), len(points) + 1), bool)
    seen[:, -1] = True
    nodes = np.full((len(queries), beam), -1)
    score = np.full((len(queries), beam), -np.inf, np.float32)
    nodes[:, : starts.shape[1]] = starts
    first = np.einsum("qd,qkd->qk", queries, points[starts])
    score[:, : starts.shape[1]] = np.where(starts < 0, -np.inf, first)
    seen[rows, starts] = True
    done = nodes < 0
    while not done.all():
        pending = np.where(done, -np.inf, score)
        pick = np.argpartition(-pending, STEP - 1, axis=1)[:, :STEP] if beam > STEP else np.tile(np.arange(beam), (len(rows), 1))
        live = ~np.take_along_axis(done, pick, 1)
        np.put_along_axis(done, pick, True, 1)
        from_ = np.where(live, np.take_along_axis(nodes, pick, 1), -1)
        next_ = np.where((from_ >= 0)[:, :, None], links[from_], -1).reshape(len(queries), -1)
        next_ = np.sort(next_, axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
        next_[seen[rows, next_]] = -1
        seen[rows, next_] = True
        new = np.where(next_ < 0, -np.inf, np.einsum("qd,qkd->qk", queries, points[next_]))
        all_score = np.concatenate([score, new.astype(np.float32)], axis=1)
        best = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        nodes = np.take_along_axis(np.concatenate([nodes, next_], axis=1), best, 1)
        done = np.take_along_axis(np.concatenate([done, next_ < 0], axis=1), best, 1)
        score = np.take_along_axis(all_score, best, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1)


def search(
    points: np.ndarray,
    layers: list[tuple[np.ndarray, np.ndarray]],
    marks: np.ndarray,
    queries: np.ndarray,
    beam: int = BEAM,
) -> np.ndarray:
    """Nodes found for every query, from the top layer and from the best landmarks down."""
    entry = layers[-1][0][:STARTS].astype(np.int64)
    starts = np.tile(entry, (len(queries), 1))
    for nodes, links in layers[:0:-1]:
        within = np.searchsorted(nodes, np.maximum(starts, 0))
        within[starts < 0] = -1
        found = walk(points[nodes], links, queries, within, max(STARTS, starts.shape[1]))
        starts = np.where(found >= 0, nodes[found], -1)[:, :STARTS]
    near = queries @ points[marks].T
    count = min(LANDMARKS, len(marks))
    best = marks[np.argpartition(-near, count - 1, axis=1)[:, :count]].astype(np.int64)
    # Landmarks among the starts already count once.
    best[(best[:, :, None] == starts[:, None, :]).any(axis=2)] = -1
    starts = np.concatenate([starts, best], axis=1)
    return walk(points, layers[0][1], queries, starts, max(beam, starts.shape[1]))


def valid_vectors(table: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v (doubles) of the vectors that take part."""
    rows = table.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (length["n"] if length else 0))


def build_graphs(rows: DataFrame, shards: int, k: int = NEAREST) -> DataFrame:
    """One row per shard with its vectors, ids, layers and landmarks as flat arrays, for searches of up to ``k``."""

    def of_shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values = np.array(group["v"].tolist(), np.float64)
        ids = group["id"].to_numpy(np.int64)
        distinct, home = np.unique(values, axis=0, return_inverse=True)
        home = home.ravel()
        order = np.lexsort((ids, home))
        # Of copies the smallest ids count, one more than a result holds: a query's own may be among them.
        place = np.arange(len(ids)) - np.searchsorted(home[order], home[order])
        order = order[place <= k]
        ends = np.cumsum(np.bincount(home[order], minlength=len(distinct)))
        layers = build(distinct.astype(np.float32))
        return pd.DataFrame(
            {
                "shard": [key[0]],
                "n": [len(distinct)],
                "width": [distinct.shape[1]],
                "vectors": [distinct.tobytes()],
                "ids": [ids[order].tobytes()],
                "id_ends": [ends.astype(np.int64).tobytes()],
                "layer_nodes": [[nodes.tobytes() for nodes, _ in layers]],
                "layer_links": [[links.tobytes() for _, links in layers]],
                "landmarks": [landmarks(layers).tobytes()],
            }
        )

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    return rows.withColumn("shard", shard).groupBy("shard").applyInPandas(of_shard, GRAPH)


def search_graphs(graphs: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int, beam: int) -> DataFrame:
    """The best of every query in every shard: query_id, vec_id, score."""

    def of_pair(key: tuple, asked: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        for row in graph.itertuples():
            vectors = np.frombuffer(row.vectors).reshape(row.n, row.width)
            ids, ends = np.frombuffer(row.ids, np.int64), np.frombuffer(row.id_ends, np.int64)
            counts = np.diff(ends, prepend=0)
            layers = [
                (np.frombuffer(nodes, np.int32), np.frombuffer(links, np.int32).reshape(-1, 2 * LINKS))
                for nodes, links in zip(row.layer_nodes, row.layer_links)
            ]
            points, marks = vectors.astype(np.float32), np.frombuffer(row.landmarks, np.int32)
            for at in range(0, len(asked), 256):
                part = asked.iloc[at : at + 256]
                wanted = np.array(part["v"].tolist(), np.float64)
                found = search(points, layers, marks, wanted.astype(np.float32), max(beam, k + 1))
                owner, place = np.nonzero(found >= 0)
                node = found[owner, place]
                score = (wanted[owner] * vectors[node]).sum(axis=1)
                # Every id of a node is a candidate.
                times = counts[node]
                owner, score = np.repeat(owner, times), np.repeat(score, times)
                first = np.repeat(ends[node] - times, times)
                step = np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)
                vec = ids[first + step]
                query = part["id"].to_numpy(np.int64)[owner]
                other = query != vec
                owner, score, vec, query = owner[other], score[other], vec[other], query[other]
                order = np.lexsort((vec, -score, owner))
                owner, score, vec, query = owner[order], score[order], vec[order], query[order]
                best = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
                out.append((query[best], vec[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    numbers = F.sequence(F.lit(0), F.lit(shards - 1))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(numbers)
    )
    held = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return (
        asked.groupBy("shard", "block")
        .cogroup(held.groupBy("shard", "block"))
        .applyInPandas(of_pair, "query_id long, vec_id long, score double")
    )


def nearest_neighbours(
    table: DataFrame,
    every: int = 20,
    k: int = NEAREST,
    shard_rows: int = SHARD_ROWS,
    beam: int = BEAM,
    id_: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row whose id is divisible by ``every``."""
    rows = valid_vectors(table, id_, vector)
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    # A row per id and vector: what repeats is expanded again from the graph's lists of ids.
    graphs = materialize(build_graphs(rows, shards, k), "graphs")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-n // (every * QUERY_ROWS)))
    found = search_graphs(graphs, queries, shards, blocks, k, beam)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
