"""Ranked lexical search as a search for largest inner products, with buckets of vectors of like length.

A document is the vector of the impacts of its terms, an item asks for the sum of
the impacts of its terms: an inner product with a vector of ones. Documents are
looked at in blocks; in a block they are ordered by length and cut into buckets,
longest first. The score of the last of an item's best documents so far prunes:

* Cauchy-Schwarz: a bucket, and all after it, cannot hold a better document if
  its greatest length times the length of the item stays below that score;
* coordinate bounds: terms whose greatest impacts in the bucket add up to less
  cannot lift a document alone, so only documents with another term of the item
  are looked at; of these, only those go on whose impacts so far, with the
  smaller of two bounds for the rest (greatest impacts, or what is left of the
  document's length), reach that score.

What remains is scored exactly in 64-bit integers. Bounds are doubles and are
widened by more than their rounding, so no document of the result is lost.

Documents are read once per block of items and not shuffled: the terms that some
item asks for go into a table together with the counts of the corpus, and every
task of the second pass returns its best documents of each item. A block of
items is bounded by the bytes of its texts, which is what the driver holds and
broadcasts; larger tables of items take more blocks.

A term is a run of ASCII letters and digits and of all other characters beyond
ASCII, only A-Z lower-cased. A null or empty text has no terms: such documents
are in no result, such items get no rows. Rows that repeat a doc_id are documents
of their own; rows that repeat an item_id are one item, which asks for the terms
of all of them. Null ids are ids like any other, and come first among equal
scores. Empty tables give no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavelead.storage import materialize, new_path

# Bytes of the texts of a block of items.
ITEM_BYTES = 8 << 20
# Impacts that a task holds at a time, and documents in a bucket.
BLOCK_IMPACTS = 1 << 21
BUCKET = 1024
# Bounds are raised by this share before a document is left out.
SLACK = 1e-9
# Stretches in which the best documents of an item are ranked first.
SALTS = 32

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

def _folded() -> bytes:
    """What every byte of a text becomes: a blank between terms, a-z for A-Z, itself otherwise."""
    letters = range(ord("A"), ord("Z") + 1)
    return bytes(b + 32 if b in letters else 32 if b in _SEPARATORS else b for b in range(256))


FOLD = _folded()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a column of texts one after another, and where each text's terms begin and end."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(1, np.int64)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    folded = (data.to_pybytes() if data else b"").translate(FOLD)
    texts = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(folded))
    split = pc.ascii_split_whitespace(texts)
    terms, ends = split.flatten(), np.asarray(split.offsets) - split.offsets[0].as_py()
    full = np.asarray(pc.greater(pc.binary_length(terms), 0))
    return terms.filter(pa.array(full)), np.append(0, np.cumsum(full))[ends]


VECTORS = "kind string, doc_id long, n long, terms array<int>, counts array<int>"


def term_vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Occurrences of the vocabulary's terms in every document that has one, and the counts of the corpus.

    Kinds: ``vector`` is a document, with ``n`` terms in all; ``holds`` has, for
    each term, how many documents of one task hold it; ``size`` has a task's
    documents with a term (``doc_id``) and their terms (``n``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array([t.decode("utf-8") for t in shared.value], pa.string())
        holds, documents, total = np.zeros(len(wanted), np.int64), 0, 0

        def rows(kind, doc_id, n, offsets, terms, counts):
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in (terms, counts)]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), doc_id, pa.array(n, pa.int64()), *lists], schema=schema)

        schema = pa.schema(
            [
                ("kind", pa.string()),
                ("doc_id", pa.int64()),
                ("n", pa.int64()),
                ("terms", pa.list_(pa.int32())),
                ("counts", pa.list_(pa.int32())),
            ]
        )
        for batch in batches:
            terms, ends = split_terms(batch.column(1))
            n = np.diff(ends)
            documents += int((n > 0).sum())
            total += int(n.sum())
            which = pc.index_in(terms, value_set=wanted)
            asked = np.flatnonzero(np.asarray(which.is_valid()))
            row = np.searchsorted(ends, asked, "right") - 1
            found, counts = np.unique(row * len(wanted) + np.asarray(which.take(pa.array(asked))), return_counts=True)
            row, term = np.divmod(found, max(len(wanted), 1))
            holds += np.bincount(term, minlength=len(wanted))
            held, size = np.unique(row, return_counts=True)
            if len(held):
                ids = batch.column(0).take(pa.array(held))
                yield rows("vector", ids, n[held], np.append(0, np.cumsum(size)), term, counts)
        seen = np.flatnonzero(holds)
        yield rows("holds", pa.array([None], pa.int64()), [0], [0, len(seen)], seen, holds[seen])
        yield rows("size", pa.array([documents], pa.int64()), [total], [0, 0], seen[:0], seen[:0])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, VECTORS)


class Best:
    """The ``k`` best documents of an item so far, by falling score and rising id, null first."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.valid = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The score that a further document has to reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        scores, ids, valid = (
            np.concatenate(both) for both in ((self.scores, scores), (self.ids, ids), (self.valid, valid))
        )
        order = np.lexsort((ids, valid, -scores))[: self.k]
        self.scores, self.ids, self.valid = scores[order], ids[order], valid[order]


class Bucket:
    """Impacts of some documents, term by term: ``rows[a:b]`` hold a term, with ``impacts[a:b]``."""

    def __init__(self, size: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray, squares: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.size, self.squares = size, squares
        self.rows, self.impacts = row[order], impact[order]
        self.terms, self.starts = np.unique(term[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(row))
        self.greatest = np.maximum.reduceat(self.impacts, self.starts)

    def candidates(self, asked: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose score may reach ``least``, and their exact scores."""
        at = np.searchsorted(self.terms, asked)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == asked]
        at = at[np.argsort(self.greatest[at], kind="stable")]
        together = np.cumsum(self.greatest[at])
        weak = int(np.searchsorted(together, least, "left"))
        if weak == len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores, squares = np.zeros(self.size, np.int64), np.zeros(self.size)
        for t in at[weak:].tolist():
            a, b = self.starts[t], self.ends[t]
            scores[self.rows[a:b]] += self.impacts[a:b]
            squares[self.rows[a:b]] += self.impacts[a:b].astype(float) ** 2
        bound = np.full(self.size, float(together[weak - 1]) if weak else 0.0)
        rest = np.sqrt(weak * np.maximum(self.squares * (1 + SLACK) - squares, 0))
        reach = (scores + np.minimum(bound, rest)) * (1 + SLACK) >= least
        reach &= scores > 0
        for t in at[:weak].tolist():
            a, b = self.starts[t], self.ends[t]
            some = reach[self.rows[a:b]]
            scores[self.rows[a:b][some]] += self.impacts[a:b][some]
        rows = np.flatnonzero(reach & (scores >= least))
        return rows, scores[rows]


def impacts_of(n: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Weight times the saturated frequency of a term that occurs ``counts`` times among ``n``."""
    length = 50 + (50 * n * documents) // total
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * length))


def search_block(
    best: list[Best], items: list[np.ndarray], doc_ids: pa.Array, size: np.ndarray, term: np.ndarray, impact: np.ndarray
) -> None:
    """Bring the best documents of all items up to date with a block of documents."""
    valid, ids = np.asarray(doc_ids.is_valid()), np.asarray(pc.fill_null(doc_ids, 0))
    row = np.repeat(np.arange(len(size)), size)
    squares = np.bincount(row, impact.astype(float) ** 2, len(size))
    order = np.argsort(-squares, kind="stable")
    starts = np.cumsum(size) - size
    active = list(range(len(items)))
    for a in range(0, len(order), BUCKET):
        some = order[a : a + BUCKET]
        longest = math.sqrt(squares[some[0]]) * (1 + SLACK)
        active = [i for i in active if longest * math.sqrt(len(items[i])) >= best[i].least]
        if not active:
            return
        held = size[some]
        local = np.repeat(np.arange(len(some)), held)
        at = np.repeat(starts[some] - (np.cumsum(held) - held), held) + np.arange(len(local))
        bucket = Bucket(len(some), local, term[at], impact[at], squares[some])
        for i in active:
            rows, scores = bucket.candidates(items[i], best[i].least)
            if len(rows):
                best[i].add(scores, ids[some[rows]], valid[some[rows]])


def search(vectors: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """The ``k`` best documents of every item among those of each task: item (its number), doc_id, score."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, weights))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(k) for _ in items]
        held, held_impacts = [], 0

        def block() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            doc_ids, n, terms, counts = (c.chunk(0) for c in table.columns)
            size = np.diff(np.asarray(terms.offsets)).astype(np.int64)
            term = np.asarray(terms.flatten()).astype(np.int64)
            counts = np.asarray(counts.flatten()).astype(np.int64)
            impact = impacts_of(np.repeat(np.asarray(n), size), counts, weights[term], documents, total)
            some = impact > 0
            row = np.repeat(np.arange(len(size)), size)[some]
            search_block(best, items, doc_ids, np.bincount(row, minlength=len(size)), term[some], impact[some])

        for batch in batches:
            # A batch of long documents goes on in parts, so that a block stays bounded.
            ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(2)))) if batch.num_rows else []
            cuts = np.searchsorted(ends, np.arange(BLOCK_IMPACTS, (ends[-1] if len(ends) else 0) + 1, BLOCK_IMPACTS)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a < b:
                    held.append(batch.slice(a, b - a))
                    held_impacts += int(ends[b - 1] - (ends[a - 1] if a else 0))
                if held_impacts >= BLOCK_IMPACTS:
                    block()
                    held, held_impacts = [], 0
        if held:
            block()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best)), [len(b.scores) for b in best]), pa.int64()),
                pa.array(
                    np.concatenate([np.zeros(0, np.int64), *[b.ids for b in best]]),
                    pa.int64(),
                    mask=~np.concatenate([np.zeros(0, bool), *[b.valid for b in best]]),
                ),
                pa.array(np.concatenate([np.zeros(0, np.int64), *[b.scores for b in best]]), pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )

    return vectors.select("doc_id", "n", "terms", "counts").mapInArrow(look, "item long, doc_id long, score long")


def top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` rows of highest score of every group with their rank, equal scores by doc_id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // item_bytes)
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    paths = []
    for number in range(blocks):
        asked: dict[int | None, set[bytes]] = {}
        for item_id, text in items.filter(block == number).collect():
            asked.setdefault(item_id, set()).update(terms_of(text))
        asked = {i: t for i, t in asked.items() if t}
        if asked:
            paths.append(new_path(spark, "found"))
            _search_items(docs, asked, k).write.parquet(paths[-1])
    schema = "item_id long, doc_id long, score long"
    found = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    best = top(salted, ["item_id", "salt"], k).select("item_id", "doc_id", "score")
    return top(best, ["item_id"], k).select("item_id", "rank", "doc_id", "score")


def _search_items(docs: DataFrame, asked: dict[int | None, set[bytes]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*asked.values()))
    number = {t: n for n, t in enumerate(vocabulary)}
    terms = materialize(term_vectors(docs, vocabulary), "term-vectors", ("kind",))
    documents, total = terms.filter("kind = 'size'").agg(F.sum("doc_id"), F.sum("n")).first()
    counts = (
        terms.filter("kind = 'holds'")
        .select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        .groupBy("t.terms")
        .agg(F.sum("t.counts").alias("n"))
    )
    holds = np.zeros(len(vocabulary), np.int64)
    for row in counts.collect():  # a row per term of the block
        holds[row["terms"]] = row["n"]
    documents, total = documents or 0, total or 0
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * h + 1))) for h in holds.tolist()], np.int64)
    items = [np.array(sorted(map(number.__getitem__, t)), np.int64) for t in asked.values()]
    found = search(terms.filter("kind = 'vector'"), items, weights, documents, total, k)
    ids = spark.createDataFrame(list(enumerate(asked)), "number long, item_id long")
    return found.join(ids, found["item"] == ids["number"]).select("item_id", "doc_id", "score")
