"""Pack documents into sequences of a fixed number of tokens.

First-fit decreasing with a tournament tree over the free room of the open
sequences, run independently in randomised groups of documents. A document of
more than one sequence fills whole sequences first; its tail is packed.

Nulls: a null text counts as empty, a null id is an id like any other. Every
document has at least its end id, so it has at least one piece. Rows that occur
repeatedly are packed as often as they occur. An empty table gives no pieces.
Only the id and text columns are read; others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelead.llm.bpe import WordBpe

SIZE = 4096
# Documents in a group on average: what one task sorts and places at a time.
GROUP_DOCS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FirstFit:
    """Open bins by their free room, in a tournament tree: finding the first bin with room takes log(n) steps."""

    def __init__(self, items: int, size: int):
        self.leaves = 1 << max(items - 1, 0).bit_length()
        # A bin that is not open yet has all its room, so it is found after the open ones.
        self.room = [size] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for ``length``, and the room that it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        had = room[node]
        room[node] = had - length
        bin_ = node - self.leaves
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; items of equal length keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = FirstFit(len(lengths), size)
    for k in np.argsort(-lengths, kind="stable").tolist():
        bin_, had = tree.place(int(lengths[k]))
        bins[k], offsets[k] = bin_, size - had
    return bins, offsets


def document_ids(docs: DataFrame, vocabulary: str, end: int, size: int = SIZE) -> DataFrame:
    """doc_id, number of ids, and the CRC of each full stretch of ``size`` ids and of the tail.

    The ids themselves are not moved: where a document is cut does not depend
    on how the tails are packed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    tail = np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(shared.value)
        for batch in batches:
            counts, crcs = [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "") + tail
                counts.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[k : k + 4 * size]) for k in range(0, len(ids), 4 * size)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                names=["doc_id", "doc_tokens", "crcs"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        encode, "doc_id long, doc_tokens long, crcs array<long>"
    )


def pack(documents: DataFrame, n_docs: int, size: int = SIZE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of ``documents`` (doc_id, doc_tokens, crcs); about ``n_docs`` rows.

    ``sequence_id`` has the group in its upper bits. Equal rows are counted
    first and then dealt over all groups, so rows that repeat do not meet in
    one of them.
    """
    groups = max(1, -(-n_docs // group_docs))
    dealt = (
        documents.groupBy("doc_id", "doc_tokens", "crcs")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id",
            "doc_tokens",
            "crcs",
            F.pmod(F.xxhash64("doc_id", "copy", F.lit(10)), F.lit(groups)).alias("bucket"),
        )
    )

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens"], kind="stable", na_position="first", ignore_index=True)
        n = rows["doc_tokens"].to_numpy()
        full, rest = n // size, n % size
        tails = np.flatnonzero(rest)
        bins, offsets = first_fit_decreasing(rest[tails], size)
        opened = int(bins.max()) + 1 if len(bins) else 0
        whole = np.repeat(np.arange(len(n)), full)
        start = np.concatenate([np.arange(k) for k in full]) * size if len(whole) else np.zeros(0, np.int64)
        doc = np.concatenate([tails, whole])
        number = np.concatenate([full[tails], start // size]).astype(np.int64)
        crcs = rows["crcs"].tolist()
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].astype("Int64").take(doc).reset_index(drop=True),
                "start": number * size,
                "length": np.concatenate([rest[tails], np.full(len(whole), size)]),
                "ids_crc32": [crcs[d][k] for d, k in zip(doc.tolist(), number.tolist())],
                "doc_tokens": n[doc],
                "sequence_id": (int(key[0]) << 32)
                + np.concatenate([bins, opened + np.arange(len(whole), dtype=np.int64)]),
                "offset": np.concatenate([offsets, np.zeros(len(whole), np.int64)]),
            }
        )

    return dealt.groupBy("bucket").applyInPandas(place, PIECES)


def pack_documents(docs: DataFrame, vocabulary: str, end: int = 2, size: int = SIZE) -> DataFrame:
    """One row per piece of a document: where it starts in the document, its sequence, its place there."""
    return pack(document_ids(docs, vocabulary, end, size), docs.count(), size)
