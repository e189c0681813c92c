"""Near-duplicate documents: MinHash with tensored tables, and links confirmed on full sets.

A document is the set of its distinct 5-word shingles. Two are linked if the
sets' Jaccard similarity is at least ``threshold``; a class is what links reach.

Candidates. With m half keys on either side, of a few minhashes each, every
pair (u_i, v_j) is a table key: m * m tables from 2 m half keys, so the minhashes
needed are about the square root of what as many plain bands would take. A pair
of similarity s is missed only if all u or all v half keys differ. Tables are
formed only where u_i is shared by two documents at all; nearly all documents
drop out there.

Links. Documents with equal sets are one class from the start. In every bucket
of a table all members are compared with a pivot, then the classes found so far
are joined, and buckets whose members are in one class are done; so groups of
copies cost as many comparisons as they have members. Such a comparison looks at
the minhashes first (five standard deviations below the threshold), then counts
on full sets. After ``ROUNDS`` pivots the buckets that are left are joined into
clusters, and their documents dealt into tiles of about ``TILE``. Two tiles at a
time meet in a task, which counts the common shingles of all their pairs at once;
tiles of a cluster's largest class don't meet each other. So no candidate is left
out, no pair becomes a row unless it is a link, and no task has more than two
tiles.

Words are stretches without ASCII white space, A-Z in lower case. A document of
fewer than five words is its whole sequence; without words it has no set and no
links. A null id has no links and no class. Rows with the same id are in one class
with all that any of their texts is linked with.
Empty tables give empty results. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelead.llm.graph import components
from wavelead.llm.text import ByteHashes, WordHashes, grams, mix
from wavelead.storage import materialize, settle

WORDS = 5
THRESHOLD = 85
# Half keys on a side, and minhashes in each: 256 tables; a pair at the
# threshold is missed with a chance of 5e-7.
HALVES = 16
WIDTH = 3
ROUNDS = 2
TILE = 256
_HASHES = 2 * HALVES * WIDTH


def shingle_set(text: str, hashes: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    # bytes.lower and bytes.split know ASCII only, as the definition of a word does.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = hashes.of(words)
    if len(words) < n:
        return grams(np.append(each, np.uint64(len(words))), len(words) + 1)
    return np.unique(grams(each, n))


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def minhashes(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest value of every hash function over the set; taken in stretches, so memory is bounded."""
    a, b = factors
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[None, at : at + 2048] * a[:, None] + b[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best


def half_keys(values: np.ndarray) -> np.ndarray:
    """2 * HALVES keys of WIDTH minhashes each."""
    rows = values.reshape(-1, WIDTH)
    key = np.zeros(len(rows), np.uint64)
    for k in range(WIDTH):
        key = mix(key + rows[:, k])
    return key


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, n_shingles, two hashes of the set, half keys of both sides, a byte of every minhash."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = ByteHashes(), multipliers(_HASHES)
        longs = pa.list_(pa.int64())
        for batch in batches:
            n, one, two, u, v, sig = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text, hashes)
                whole = xxhash.xxh3_128_digest(found.tobytes())
                n.append(len(found))
                one.append(int.from_bytes(whole[:8], "little", signed=True))
                two.append(int.from_bytes(whole[8:], "little", signed=True))
                values = minhashes(found, factors) if len(found) else np.zeros(_HASHES, np.uint64)
                keys = half_keys(values).view(np.int64)
                u.append(keys[:HALVES])
                v.append(keys[HALVES:])
                sig.append((mix(values) >> np.uint64(56)).astype(np.uint8).tobytes())
            columns = [pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            columns += [pa.array(u, longs), pa.array(v, longs), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    schema = "doc_id long, text_hash long, n_shingles long, set1 long, set2 long, u array<long>, v array<long>, sig binary"
    names = [part.split()[0] for part in schema.split(", ")]
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text).mapInArrow(sign, schema)


def set_classes(signed: DataFrame) -> DataFrame:
    """One row per set: node, the smallest id (``doc``) that has it with the hash of its text, and what links need.

    The node of a set is that id. If several sets have the same one, the first
    of them has it and the others get numbers beyond all ids; as all sets of an
    id are joined, the smallest node of a class is an id still.
    """
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(
        full.groupBy("set1", "set2").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("of"),
            F.first("n_shingles").alias("n"),
            F.first("u").alias("u"),
            F.first("v").alias("v"),
            F.first("sig").alias("sig"),
        ).select("set1", "set2", F.col("of.doc_id").alias("doc"), "of.text_hash", "n", "u", "v", "sig"),
        "sets-of-ids",
    )
    several = classes.groupBy("doc").agg(F.min(F.struct("set1", "set2")).alias("first"), F.count(F.lit(1)).alias("c"))
    top = classes.agg(F.max("doc")).first()[0] or 0
    joined = classes.join(several.where("c > 1").drop("c"), "doc", "left")
    own = F.col("first").isNull() | (F.col("first") == F.struct("set1", "set2"))
    node = F.when(own, F.col("doc")).otherwise(F.lit(top + 1) + F.monotonically_increasing_id())
    return materialize(joined.withColumn("node", node).drop("first"), "set-classes")


def sets_of_one_id(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of an id that occurs with several texts."""
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "set1", "set2")
    of = F.struct("set1", "set2")
    several = full.groupBy("doc_id").agg(F.min(of).alias("low"), F.max(of).alias("high")).where("low < high")
    sets = full.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    found = sets.join(nodes.select("set1", "set2", "node"), ["set1", "set2"]).select("doc_id", "node")
    least = found.groupBy("doc_id").agg(F.min("node").alias("a"))
    return found.join(least, "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node and its set, from (node, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = ByteHashes()
        for batch in batches:
            sets = [shingle_set(t, hashes).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    return docs.mapInArrow(build, "node long, shingles array<long>")


def candidate_buckets(nodes: DataFrame) -> DataFrame:
    """key, node, n: members of the buckets with at least two, one bucket for each set of members."""
    halves = nodes.select(
        "node", F.explode(F.transform("u", lambda x, i: F.xxhash64(i, x))).alias("half")
    )
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    tables = halves.join(shared, "half").join(nodes.select("node", "n", "v"), "node")
    rows = materialize(
        tables.select(
            "node", "n", "half", F.posexplode("v").alias("j", "other")
        ).select(F.xxhash64("half", "j", "other").alias("key"), "node", "n"),
        "tables",
    )
    buckets = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    kept = buckets.where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")
    return rows.join(kept, "key")


def _ratio_allows(a: Column, b: Column, threshold: int) -> Column:
    """Sets of these sizes can be similar enough."""
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    s = threshold / 100
    least = s - 5 * math.sqrt(s * (1 - s) / _HASHES)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8) for k in (2, 3))
                same = (a == b).reshape(batch.num_rows, _HASHES).sum(axis=1)
                batch = batch.filter(pa.array(same >= least * _HASHES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    def of(table: DataFrame, column: str, side: str) -> DataFrame:
        return table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}"))

    near = (
        pairs.join(of(nodes, "sig", "a"), "a").join(of(nodes, "sig", "b"), "b")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(alike, "a long, b long")
    )
    full = near.join(of(sets, "shingles", "a"), "a").join(of(sets, "shingles", "b"), "b")
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    counted = full.select("a", "b", common.alias("i"), (F.size("shingles_a") + F.size("shingles_b")).alias("n"))
    return counted.where(100 * F.col("i") >= threshold * (F.col("n") - F.col("i"))).select("a", "b")


def common_shingles(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``a`` with the sets ``b``, by products of 0/1 matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle that one set alone has is common to no pair.
    shared = count > 1
    place = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        first, last = np.searchsorted(column, [at, at + 4096])
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[first:last], column[first:last] - at] = 1
        total += table[a] @ table[b].T
    return total


def compare_tiles(rows: DataFrame, threshold: int) -> DataFrame:
    """Links between classes among (cluster, low, high, tile, node, class, shingles), one per two classes."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tile, node, class_ = (rows[c].to_numpy(np.int64) for c in ("tile", "node", "class"))
        a, b = np.flatnonzero(tile == key[1]), np.flatnonzero(tile == key[2])
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        sets = rows["shingles"].tolist()
        sizes = np.array([len(x) for x in sets])
        common = common_shingles(sets, a, b)
        union = sizes[a][:, None] + sizes[b][None, :] - common
        linked = (100 * common >= threshold * union) & (class_[a][:, None] != class_[b][None, :])
        i, j = np.nonzero(linked)
        i, j = a[i], b[j]
        ends = np.sort(np.stack([class_[i], class_[j]], axis=1), axis=1)
        _, one = np.unique(ends, axis=0, return_index=True)
        return pd.DataFrame({"a": node[i[one]], "b": node[j[one]]})

    return rows.groupBy("cluster", "low", "high").applyInPandas(compare, "a long, b long")


def tiles(rest: DataFrame, tile: int = TILE) -> DataFrame:
    """cluster, low, high, tile, node, class: which tiles of a cluster have to meet.

    ``rest`` has the members (key, node, class) of the buckets to be looked
    through. The documents of a cluster's largest class have tiles of their own,
    after those of all others; a tile of the others meets every tile.
    """
    pivots = rest.groupBy("key").agg(F.min("node").alias("pivot"))
    edges = rest.join(pivots, "key").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    nodes = rest.select("node", "class").distinct()
    placed = materialize(
        components(edges).select("node", F.col("component").alias("cluster")).join(nodes, "node"), "clusters"
    )
    sizes = placed.groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"))
    of_cluster = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "class")).alias("most"), F.sum("n").alias("n")
    )
    others, most = F.col("n") - F.col("most.n"), F.col("most.n")
    counts = of_cluster.select(
        "cluster",
        F.col("most.class").alias("main"),
        F.greatest(F.ceil(others / tile), F.lit(1)).cast("int").alias("n_others"),
        F.ceil(most / tile).cast("int").alias("n_main"),
    )
    spread = F.xxhash64("node", F.lit(7))
    is_main = F.col("class") == F.col("main")
    own = F.when(is_main, F.col("n_others") + F.pmod(spread, "n_main")).otherwise(F.pmod(spread, "n_others"))
    last = F.when(is_main, F.col("n_others") - 1).otherwise(F.col("n_others") + F.col("n_main") - 1)
    return (
        placed.join(counts, "cluster")
        .select("cluster", "node", "class", own.cast("int").alias("tile"), last.alias("last"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
        .select(
            "cluster", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "class"
        )
    )


def links(
    nodes: DataFrame,
    docs: DataFrame,
    threshold: int = THRESHOLD,
    rounds: int = ROUNDS,
    tile: int = TILE,
    known: DataFrame | None = None,
) -> DataFrame:
    """Classes of ``nodes`` (``set_classes``) that have a link: node, component. ``known`` are links from the start.

    Where nodes have no ``doc`` and ``text_hash`` they are the ids of ``docs``.
    """
    members = materialize(candidate_buckets(nodes), "buckets")
    wanted = members.select("node").distinct()
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), text)
    if "text_hash" in nodes.columns:
        places = nodes.join(wanted, "node", "left_semi").select("node", "doc", "text_hash")
        texts = texts.join(places, ["doc", "text_hash"]).select("node", "text")
    else:
        texts = texts.select(F.col("doc").alias("node"), "text").join(wanted, "node", "left_semi")
    sets = materialize(shingle_sets(texts).dropDuplicates(["node"]), "sets")
    signed = materialize(nodes.join(wanted, "node", "left_semi").select("node", "sig"), "signed")

    found, rows = known, members.withColumn("class", F.col("node"))
    if known is not None:
        rows = with_classes(members, components(known))
    for turn in range(rounds + 1):
        mixed = rows.groupBy("key").agg(
            F.min("class").alias("low"),
            F.max("class").alias("high"),
            F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "class")).alias("pivot"),
        ).where(F.col("low") < F.col("high"))
        if turn < rounds:
            other = mixed.select(
                "key",
                F.col("pivot.node").alias("other"),
                F.col("pivot.n").alias("other_n"),
                F.col("pivot.class").alias("other_class"),
            )
            pairs = (
                rows.join(other, "key")
                .where(F.col("class") != F.col("other_class"))
                .where(_ratio_allows(F.col("n"), F.col("other_n"), threshold))
                .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
                .distinct()
            )
            new = materialize(confirm(pairs, signed, sets, threshold), "links")
        else:
            rest = materialize(rows.join(mixed.select("key"), "key", "left_semi"), "rest")
            met = tiles(rest, tile).join(sets, "node")
            new = materialize(compare_tiles(met, threshold), "links")
        found = new if found is None else found.unionByName(new)
        classes = components(found)
        rows = with_classes(members, classes)
    return classes


def with_classes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` with the class of their node; a node without links is its own."""
    found = members.join(classes.withColumnRenamed("component", "class"), "node", "left")
    return found.withColumn("class", F.coalesce("class", "node"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = materialize(signatures(docs), "signatures")
    nodes = set_classes(signed)
    known = materialize(sets_of_one_id(signed, nodes), "links")
    joined = links(nodes, docs, threshold, known=known if known.first() else None)
    of_sets = (
        nodes.join(joined, "node", "left")
        .select("set1", "set2", F.coalesce("component", "node").alias("component"))
    )
    rows = signed.select("doc_id", "n_shingles", "set1", "set2").join(of_sets, ["set1", "set2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    ).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_documents(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of every class, with all its columns; of rows with the same id one. Rows without id stay."""
    judged = settle(docs.sparkSession, "near-duplicates", lambda: near_duplicates(docs, threshold))
    kept = judged.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    one = rows.join(kept, F.col("_id") == F.col("_kept"), "left_semi").dropDuplicates(["_id"])
    return one.unionByName(rows.where("_id IS NULL")).select("_row.*")
