"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelead.storage import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``edges``, two LONG columns.

    Large and small stars in turn: every node's larger neighbours are tied to
    its smallest neighbour, then every node and its smaller neighbours to the
    smallest of them. The trees lose height with every turn, and a turn touches
    every edge twice. Each is written to the shared folder, so a lost executor
    costs no more than the turn it was in.
    """
    star = materialize(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "stars",
    )
    before = None
    while (state := _state(star)) != before:
        before = state
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(
            small.unionByName(root.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(),
            "stars",
        )
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(star: DataFrame) -> tuple:
    """Count and hashes of the edges: equal once a turn changes nothing."""
    row = star.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")
    ).first()
    return tuple(row)
