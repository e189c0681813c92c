"""Token ids in files: frequency ranks in a byte-aligned variable-length code.

An id is replaced by its rank among all ids of the corpus by frequency, so the
frequent ones take one byte. Ranks are written as one to four data bytes; two
bits for each, four to a control byte, say how many. Control and data bytes are
kept apart, so a reader finds all lengths by table lookup before it touches the
data.

Layout of a written corpus (both tables are Parquet, blocks of bytes in them):

* ``ranks``: rank, id, n - the ids by falling frequency, ties by id;
* ``blocks``: part, block, first (ids of the part before the block), doc_ids,
  lengths (ids per document), control, data. Documents stand in ascending order
  of doc_id over (part, block). In a block the ids of every document start a
  control byte of their own; unused places of its last one hold rank 0.

A null text counts as empty, a null id sorts first. Documents with the same id
keep the order of their texts' hashes. Empty tables give empty files. Only the
id and text columns are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelead.llm.bpe_tree import shared_bpe
from wavelead.llm.text import in_parts
from wavelead.storage import materialize, new_path

# Ids in a block before it is closed.
BLOCK = 65_536
# Lengths of the four values of a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
BLOCKS = (
    "part int, block int, first long, doc_ids array<long>, lengths array<long>, control binary, data binary"
)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes; filled up with zeros to a multiple of four values."""
    ranks = np.concatenate([ranks.astype("<u4"), np.zeros(-len(ranks) % 4, "<u4")])
    sizes = 1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    bits = (sizes - 1).astype(np.uint8).reshape(-1, 4)
    control = bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes) -> np.ndarray:
    """All ranks of a block, the filling included."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    at = np.cumsum(sizes) - sizes
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        ranks[longer] |= padded[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def by_fours(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values`` of documents of the given lengths, each filled up with zeros to a multiple of four."""
    padded = -(-lengths // 4) * 4
    filled = np.zeros(int(padded.sum()), values.dtype)
    shift = np.cumsum(padded) - padded - (np.cumsum(lengths) - lengths)
    filled[np.repeat(shift, lengths) + np.arange(len(values))] = values
    return filled


def id_width(vocabulary: str, end: int) -> int:
    """Bytes that hold any id of the vocabulary and the end id."""
    spec = json.loads(vocabulary)
    top = max([end, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    return 2 if top < 1 << 16 else 4


def encode_texts(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """doc_id, hash of the text, and the ids of the whole text with the end id, ``id_width`` bytes each.

    A last row of every task has, in ``counts``, how often each id occurs in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    narrow = f"<u{id_width(vocabulary, end)}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, total = shared_bpe(shared.value), np.zeros(0, np.int64)
        none = pa.nulls(1, pa.int64())
        for whole in batches:
            for batch in in_parts(whole, 2):
                ids = bpe.encode(batch.column(2))
                found, n = np.asarray(ids.flatten()), np.diff(np.asarray(ids.offsets))
                # One place more for every document: its end id.
                ends = np.cumsum(n + 1)
                values = np.full(len(found) + len(n), end, narrow)
                values[np.arange(len(found)) + np.repeat(np.arange(len(n)), n)] = found
                seen = np.bincount(values, minlength=len(total))
                seen[: len(total)] += total
                total = seen
                offsets = (np.append(0, ends) * values.itemsize).astype(np.int32)
                column = pa.Array.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(values)]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), column, pa.nulls(len(n), counts)], names=names
                )
        seen = np.flatnonzero(total)
        pairs = pa.StructArray.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])
        last = pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), pairs)
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(1, pa.binary()), last], names=names)

    names = ["doc_id", "text_hash", "ids", "counts"]
    counts = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))

    return docs.select(
        F.col("doc_id").cast("long"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        F.col("text").cast("string"),
    ).mapInArrow(encode, "doc_id long, text_hash long, ids binary, counts array<struct<id:long,n:long>>")


def write_tokens(docs: DataFrame, vocabulary: str, end: int, path: str, block: int = BLOCK) -> None:
    """Encode whole texts and write them under ``path`` in ascending order of doc_id.

    Texts are read and encoded once; the same pass counts the ids. What is
    range-partitioned then is the stored table of ids, which become ranks only
    where a block is closed.
    """
    spark = docs.sparkSession
    encoded = materialize(encode_texts(docs, vocabulary, end), "token-ids")
    each = encoded.where("counts IS NOT NULL").select(F.explode("counts").alias("c"))
    # At most one row per entry of the vocabulary comes to the driver.
    counts = each.groupBy("c.id").agg(F.sum("c.n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)
    counts.insert(0, "rank", np.arange(len(counts)))
    spark.createDataFrame(counts.astype("int64"), "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.uint32)
    ranks[counts["id"].to_numpy()] = counts["rank"].to_numpy()
    width = id_width(vocabulary, end)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held, size, part = 0, 0, [], 0, 0

        def closed() -> pa.RecordBatch:
            lengths = np.array([len(ids) // width for _, ids in held], np.int64)
            values = ranks[np.frombuffer(b"".join(ids for _, ids in held), f"<u{width}")]
            control, data = encode_ranks(by_fours(values, lengths))
            fields = ([part], [number], [first], [[d for d, _ in held]], [lengths], [control], [data])
            return pa.RecordBatch.from_arrays([pa.array(f, s.type) for f, s in zip(fields, SCHEMA)], schema=SCHEMA)

        for batch in batches:
            for doc_id, ids, part in zip(*[c.to_pylist() for c in batch.columns]):
                held.append((doc_id, ids))
                size += len(ids) // width
                if size >= block:
                    yield closed()
                    first, number, held, size = first + size, number + 1, [], 0
        if held:
            yield closed()

    (
        encoded.where("counts IS NULL")
        .select("doc_id", "text_hash", "ids")
        .repartitionByRange("doc_id", "text_hash")
        .sortWithinPartitions("doc_id", "text_hash")
        .select("doc_id", "ids", F.spark_partition_id().alias("part"))
        .mapInArrow(gather, BLOCKS)
        .write.parquet(f"{path}/blocks")
    )


SCHEMA = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("control", pa.binary()),
        ("data", pa.binary()),
    ]
)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a written corpus: doc_id, start, n_tokens, ids_crc32 and ``ids``.

    ``start`` counts the ids of all documents before it. Only the totals of the
    parts, one row per written partition, are summed up in one place.
    """
    table = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    ids_by_rank = np.append(table["id"].to_numpy(np.uint32), np.uint32(0))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, first, doc_ids, lengths, control, data in zip(*[c.to_pylist() for c in batch.columns]):
                values = ids_by_rank[decode_ranks(control, data)].astype("<u4")
                n = np.array(lengths, np.int64)
                padded = -(-n // 4) * 4
                at = np.cumsum(padded) - padded
                docs = [values[a : a + k] for a, k in zip(at.tolist(), n.tolist())]
                columns = [
                    pa.array([part] * len(n), pa.int32()),
                    pa.array(first + np.cumsum(n) - n, pa.int64()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(n),
                    pa.array([zlib.crc32(d.tobytes()) for d in docs], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([d.astype(np.int64) for d in docs], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["part", "local", "doc_id", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = "part int, local long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    totals = totals.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before = np.cumsum([0, *[r["n"] for r in totals]])[:-1].tolist()
    offsets = spark.createDataFrame(
        [(r["part"], b) for r, b in zip(totals, before)], "of_part int, part_start long"
    )
    rows = blocks.mapInArrow(decode, schema)
    return rows.join(offsets, F.col("part") == F.col("of_part")).select(
        "doc_id", (F.col("part_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def token_files(docs: DataFrame, vocabulary: str, end: int = 1, with_ids: bool = True) -> DataFrame:
    """Write the ids of all documents to the shared folder and read them back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, vocabulary, end, path)
    return read_tokens(docs.sparkSession, path, with_ids)
