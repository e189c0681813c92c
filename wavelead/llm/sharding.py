"""Deal documents into shards of nearly equal bytes by vector bin packing.

Groups are documents with equal texts; a group goes to one shard as a whole.
Every group is a vector (bytes, tokens, rows); the largest are placed first, each
on the shard where the dot product of its vector with the residual capacities is
highest. The law kept is that the shards' bytes are nearly equal, so a group goes
only where nearly the most bytes are left; tokens and rows are balanced along
with them.

Two steps keep every task bounded, whatever the number of groups:

1. Groups larger than a ``FINE``-th of a shard are few (at most ``FINE`` times
   the shards in each dimension) and are placed together.
2. All others are dealt by hash into blocks of ``BLOCK`` groups on average. A
   block aims at its share of what the first step left free in each shard, and
   is packed on its own.

A group with more than half the bytes or rows of a shard, or more than
``UNIT_ROWS`` rows, can't be placed evenly; it is split, by a hash of the ids,
into parts that are. Slots number the rows of a shard without gaps: by block, by
group in a block, by row in a group. Only one row per block and shard is summed
up over a shard.

A null text has no bytes and no tokens, apart from the ``OVERHEAD`` of a row.
Null texts form one group, as do empty ones. Repeated rows get a slot each. An
empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelead.storage import materialize

SHARDS = 40
OVERHEAD = 16
FINE = 64
BLOCK = 4096
UNIT_ROWS = 100_000
DIMENSIONS = ("size", "tokens", "rows")
# Shards are open to a group if they have nearly the most bytes left: within this part of its own bytes.
LEVEL = 0.5


def document_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, checksum, tokens (blank-separated words, about) and two hashes of the text: no text."""
    text = F.col("text").cast("string")
    value = F.coalesce(text, F.lit(""))
    binary = value.cast("binary")
    blanks = F.length(value) - F.length(F.translate(value, " \n\t", ""))
    digest = F.sha2(F.concat(F.when(text.isNull(), "n").otherwise("t").cast("binary"), binary), 256)
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(value).cast("long") + OVERHEAD).alias("size"),
        F.crc32(binary).alias("text_crc32"),
        F.when(F.length(value) > 0, blanks + 1).otherwise(0).cast("long").alias("tokens"),
        F.unhex(digest).alias("text_key"),
    )


def place(items: np.ndarray, residual: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Shard of every item (rows of ``items``), largest first; ``residual`` (shards, dimensions) is used up.

    Largest means most bytes. Both are measured in ``scale``, the mean capacity of a shard in each
    dimension. Ties go to the lower shard.
    """
    share = items / scale
    free = residual / scale
    shards = np.zeros(len(items), np.int64)
    for k in np.argsort(-share[:, 0], kind="stable").tolist():
        item, left = share[k], free[:, 0]
        level = left >= left.max() - LEVEL * item[0]
        best = int(np.where(level, free @ item, -np.inf).argmax())
        shards[k] = best
        free[best] -= item
    residual[:] = free * scale
    return shards


def _total(name: str) -> Column:
    return F.sum(name).cast("double").alias(name)


def assign(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    rows = materialize(document_rows(docs), "shard-rows")
    measures = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    all_ = rows.agg(*measures).first()
    total = np.array([float(all_[d] or 0) for d in DIMENSIONS])
    capacity = np.maximum(total / shards, 1e-9)

    groups = rows.groupBy("text_key").agg(*measures)
    limits = (capacity[0] / 2, min(capacity[2] / 2, UNIT_ROWS))
    parts = F.greatest(F.ceil(F.col("size") / limits[0]), F.ceil(F.col("rows") / limits[1]))
    parts = F.least(parts, F.col("rows"))
    # Hot groups: each holds more than an eightieth of all bytes or rows, or UNIT_ROWS rows.
    hot = groups.select(F.col("text_key").alias("hot_key"), parts.alias("parts")).where("parts > 1")
    split = rows.join(hot, F.col("text_key") == F.col("hot_key"), "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), "parts")).otherwise(F.lit(0))
    keyed = split.withColumn("part", part.cast("int")).drop("hot_key", "parts")
    units = materialize(keyed.groupBy("text_key", "part").agg(*measures), "shard-units")

    large = None
    for d, name in enumerate(DIMENSIONS):
        over = F.col(name) > float(capacity[d]) / FINE
        large = over if large is None else large | over
    # At most FINE * shards units in each dimension.
    first = units.where(large).toPandas().sort_values(["text_key", "part"], ignore_index=True)
    residual = np.tile(capacity, (shards, 1))
    first["shard"] = place(first[list(DIMENSIONS)].to_numpy(float), residual, capacity)
    first["within"] = first.groupby("shard")["rows"].cumsum() - first["rows"]
    first["block"] = -1
    columns = ["text_key", "part", "block", "shard", "within", "rows"]
    schema = "text_key binary, part int, block int, shard int, within long, rows long"
    placed_first = spark.createDataFrame(
        [(bytes(k), int(p), int(b), int(s), int(w), int(r)) for k, p, b, s, w, r in first[columns].itertuples(index=False)],
        schema,
    )

    small = units.where(~large)
    counted = small.agg(F.count(F.lit(1)).alias("n"), *[_total(d) for d in DIMENSIONS]).first()
    blocks = max(1, -(-int(counted["n"]) // block))
    free = np.maximum(residual, 0)
    share = free / np.maximum(free.sum(axis=0), 1e-9)

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text_key", "part"], ignore_index=True)
        items = rows[list(DIMENSIONS)].to_numpy(float)
        of_block = items.sum(axis=0)
        scale = np.maximum(of_block / shards, 1e-9)
        # Shards are taken in another order in each block, so ties don't favour the first ones.
        turn = np.roll(np.arange(shards), int(key[0]) * 7)
        found = turn[place(items, (share * of_block)[turn], scale)]
        rows["shard"] = found.astype(np.int32)
        rows["within"] = rows.groupby("shard")["rows"].cumsum() - rows["rows"]
        rows["block"] = np.int32(key[0])
        return rows[columns]

    bucket = F.pmod(F.xxhash64("text_key", "part"), F.lit(blocks)).cast("int")
    placed_small = small.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(pack, schema)
    placed = materialize(placed_first.unionByName(placed_small), "shard-places")

    # Rows of a shard in the blocks before: one row per block and shard.
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "block")
        .agg(F.sum("rows").alias("n"))
        .select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    homes = placed.join(starts, ["shard", "block"]).select(
        "text_key", "part", "shard", (F.col("start") + F.col("within")).alias("first_slot")
    )
    # A unit has at most UNIT_ROWS rows, about.
    in_unit = Window.partitionBy("text_key", "part").orderBy("doc_id")
    return (
        keyed.withColumn("at", F.row_number().over(in_unit) - 1)
        .join(homes, ["text_key", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first_slot") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "tokens",
        )
    )
